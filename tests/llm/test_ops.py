"""The corpus operators on small tables: brute force, round trips, and awkward rows."""

import math
import struct
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import ann, exact_dedup, langid, linear, mixing, near_dedup, packing, pii, shared, suffix_dedup, textbuf, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.001"
rng = np.random.default_rng(11)
WORDS = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(400)]


def words(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def docs(spark, *texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns with names that the operators use."""
    rows = [(1, "same text here", "en", "s", 5), (1, "same text here", "en", "s", 5), (None, "same text here", None, None, None), (2, None, "en", "s", 0), (3, "", None, "s", 0), (None, None, None, None, None), (4, "   \n ", "de", "s", 6), (5, words(60_000, 1), "fr", "s", 1), (6, "a" * 200_000, "es", "s", 2)]
    out = spark.createDataFrame(rows, DOCS)
    for c in ("fp", "rank", "node", "id", "luck", "row_number", "gone", "repeated_fp", "size"):
        out = out.withColumn(c, F.lit("mine"))
    return out


def counted(df):
    return Counter(map(tuple, df.collect()))


# Words


def test_words_and_shingles():
    texts = ["ein zwei drei", "", "ein  zwei\tdrei\n", "one"]
    data = "".join(texts).encode()
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    w = textbuf.Words(off, np.frombuffer(data, np.uint8))
    assert np.diff(w.first).tolist() == [3, 0, 3, 1]
    assert w.hash[:3].tolist() == w.hash[3:6].tolist() and len(set(w.hash.tolist())) == 4
    row, h = textbuf.shingles(w, 2)
    assert row.tolist() == [0, 0, 2, 2, 3] and h[:2].tolist() == h[2:4].tolist()


# 1 Toxicity


def spoken(text):
    return toxicity.language_model(np.bincount(toxicity.grams(np.frombuffer(text.encode(), np.uint8)), minlength=toxicity.SYMBOLS**4))


INSULTS = "idiot moron worthless trash scum"


def test_restoring_of_disguises():
    r = toxicity.Restorer(spoken((" ".join(WORDS) + f" {INSULTS} ") * 3))
    disguises = [("1d10t", "idiot"), ("i d i o t", "idiot"), ("i\nd\ni\no\nt", "idiot"), ("i     d   i   o  t", "idiot"), ("id iot", "idiot"), ("i d io t", "idiot"), ("i . d . i . o . t", "idiot"), ("IDIOOOT!!", "idiot"), ("m0r0n", "moron"), ("tr ash", "trash"), ("tr@$h", "trash"), ("5cum,", "scum"), ("$cum", "scum"), ("sc*m", "scum"), ("idіоt", "idiot"), ("m o r o n  i d i o t", "moron")]
    for disguised, word in disguises:
        assert word in r.words(f"ab {disguised} cd"), disguised
    for clean in ("the idiom", "morons", "a b c d", "1234", "x@y.com", "transh", "discum", "5 of 10", ""):
        assert not r.words(clean) & set(INSULTS.split()), clean


def test_viterbi_equals_all_paths():
    """Every path of short lattices, enumerated; the decoded one costs least."""
    costs = spoken((" ".join(WORDS[:60]) + f" {INSULTS} ") * 3)

    def paths(text, i, last, history, out, cost):
        if i == len(text):
            yield out.strip(), cost + (float(costs[history * toxicity.SYMBOLS]) if history % toxicity.SYMBOLS else 0)
            return
        for width, letter, more in toxicity.edges(text, i, last):
            if letter is None:
                yield from paths(text, i + width, last, history, out, cost + more)
                continue
            s = toxicity.symbol(letter)
            if s == toxicity.EDGE and not history % toxicity.SYMBOLS:
                yield from paths(text, i + width, "", 0, out, cost + more)
                continue
            code = history * toxicity.SYMBOLS + s
            yield from paths(text, i + width, "" if s == toxicity.EDGE else letter, 0 if s == toxicity.EDGE else code % toxicity.SYMBOLS**3, out + letter, cost + more + float(costs[code]))

    r = np.random.default_rng(13)
    texts = ["1d10t", "i d i o", "sc*m!", "|-|3", "vvv", "()#", "aa bb", "5.c.u", "ééd", "", "оо1", *("".join(r.choice(list("ids013 .*|()vu-"), r.integers(1, 6))) for _ in range(60))]
    for text in texts:
        least = {}
        for out, cost in paths(toxicity.prepared(text), 0, "", 0, "", 0.0):
            out = "".join("~" if c.isalpha() and not "a" <= c <= "z" else c for c in out)
            least[out] = min(cost, least.get(out, np.inf))
        assert least[toxicity.decode(text, costs.tolist())] == pytest.approx(min(least.values())), text


def test_language_model_is_a_distribution():
    costs = spoken("the cat sat on the mat\n")
    assert np.allclose(np.exp(-costs.reshape(-1, toxicity.SYMBOLS).astype(float)).sum(axis=1), 1, atol=1e-3)
    whole, parts = (toxicity.grams(np.frombuffer(b, np.uint8)) for b in (b"ab cd\n", b"ab cd\nab cd\n"))
    assert sorted([*whole, *whole]) == sorted(parts)
    accents = toxicity.grams(np.frombuffer("àb ÇD ß\n".encode(), np.uint8))
    assert sorted(accents)[1:] == sorted(toxicity.grams(np.frombuffer(b"ab cd x\n", np.uint8)))[1:] or len(accents) == 8


def test_toxicity_learns_from_labels_and_counts_copies_once(spark):
    bad = [words(40, i) + " vileword " + words(30, 900 + i) for i in range(12)]
    copies = [words(80, 77) + " innocent"] * 9
    good = [words(60, 100 + i) for i in range(40)]
    texts = [*bad, *copies, *good, "you v1l3w0rd you", "v i l e w o r d", "vile word", "innocent"]
    d = docs(spark, *texts)
    labels = spark.createDataFrame([(i, 1, int(i < 21)) for i in range(61)], LABELS)
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, labels).collect()}
    assert len(got) == len(texts)
    assert {i for i, r in got.items() if r["toxic"]} == {*range(12), 61, 62, 63}
    assert all(r["toxic"] == (r["score"] >= 0.5) and bool(r["words"]) == (r["score"] > 0) for r in got.values())
    none = toxicity.toxicity(d, labels.limit(0)).where("toxic OR score > 0")
    assert none.count() == 0


def test_stems_with_many_endings_are_learned():
    """Every form is rare, their beginning is not."""
    r = np.random.default_rng(3)
    ends = ["".join(r.choice(list("aeioslrt"), 4)) for _ in range(300)]
    sample = [("1", toxicity.sketch(words(30, i).encode()), [*words(30, i).split(), "grolm" + ends[i]]) for i in range(20)] + [("0", toxicity.sketch(words(30, 50 + i).encode()), words(30, 50 + i).split()) for i in range(160)]
    model = toxicity.fit(sample)
    assert model.part("grolmxyz") == "grolm" and model.part("gr") is None
    assert model.score(model.evidence(["grolm" + ends[200]], ()), 30) >= 0.5 and model.score(model.evidence(words(40, 999).split(), ()), 40) < 0.5
    assert model.part("gróolm") is None and model.part("grólm") == "grolm" and model.part("groolm", True) == model.part("grolm")
    assert toxicity.fit([x for x in sample if x[0] == "1"]) is None


def test_threshold_is_the_best_cut():
    r = np.random.default_rng(4)
    for _ in range(30):
        held = [(float(x), bool(r.random() < 1 / (1 + np.exp(-x)))) for x in r.normal(size=40).round(1)]
        right = lambda cut: sum((x >= cut) == y for x, y in held)  # noqa: E731, B023
        assert right(toxicity.threshold(held)) == max(right(c) for c in [0.0, *((a + b) / 2 for (a, _), (b, _) in zip(sorted(held), sorted(held)[1:], strict=False))])
    assert toxicity.threshold([]) == 0


def test_toxicity_of_awkward_texts(spark):
    d = awkward(spark)
    got = toxicity.toxicity(d, spark.createDataFrame([(1, 1, 1), (5, 1, 0), (None, 1, 1)], LABELS)).collect()
    assert len(got) == d.count() and not any(r["toxic"] or r["score"] for r in got)
    assert toxicity.toxicity(d.limit(0), spark.createDataFrame([], LABELS)).count() == 0
    r = toxicity.Restorer(np.zeros(toxicity.SYMBOLS**4, np.float32))
    began = time.monotonic()
    for long in ("*" * 50_000, "*#" * 25_000, "a" * 200_000, "a " * 50_000, "i1" * 20_000, "*-i-" * 10_000, "1*" * 25_000, "al" * 50_000, "a1*" * 5_000):
        r.words(long)
    assert time.monotonic() - began < 60


def test_toxic_recall_by_language_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    d = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL")
    got = toxicity.toxicity(d, labels.where("doc_id % 3 > 0")).join(labels.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("label")), "doc_id").join(d.select("doc_id", "lang"), "doc_id").collect()
    for lang in {r["lang"] for r in got}:
        toxic = [r["toxic"] for r in got if r["lang"] == lang and r["label"] == 1]
        assert np.mean(toxic) > 0.8, lang
    assert np.mean([r["toxic"] for r in got if r["label"] == 1]) > 0.93
    assert np.mean([r["toxic"] for r in got if r["label"] == 0]) < 0.01


# 2 Packing


def brute_pack(items, capacity):
    """Bins of the same rules, item by item."""
    gaps, bins = [], []
    large = sorted((n for n in items if 3 * n > capacity), reverse=True)
    while large:
        a = large.pop(0)
        mate = next((i for i, b in enumerate(large) if a + b <= capacity), None)
        bins.append([a] + ([large.pop(mate)] if mate is not None else []))
    gaps = [capacity - sum(b) for b in bins]
    for n in sorted((n for n in items if 3 * n <= capacity), reverse=True):
        fit = [(g, i) for i, g in enumerate(gaps) if g >= n]
        if fit:
            _, i = min(fit)
            bins[i].append(n)
            gaps[i] -= n
        else:
            bins.append([n])
            gaps.append(capacity - n)
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_plan_matches_brute_force(seed):
    r = np.random.default_rng(seed)
    items = r.integers(1, 61, int(r.integers(1, 120))).tolist()
    bins = defaultdict(list)
    for length, lo, hi, first, each, at in packing.plan(Counter(items), 60):
        for k in range(hi - lo):
            bins[first + k // each].append((at + k % each * length, length))
    assert sorted(n for b in bins.values() for _, n in b) == sorted(items)
    for b in bins.values():  # no overlap, none over the end, at most two large ones
        end = 0
        for at, n in sorted(b):
            assert at >= end
            end = at + n
        assert end <= 60 and sum(3 * n > 60 for _, n in b) <= 2
    brute = brute_pack(items, 60)
    assert len(bins) == len(brute)
    large = lambda bs: sorted(sorted(n for n in b if 3 * n > 60) for b in bs)
    assert [x for x in large([[n for _, n in b] for b in bins.values()]) if x] == [x for x in large(brute) if x]


def test_pack_places_every_row(spark):
    d = awkward(spark)
    got = packing.pack(d, capacity=100).collect()
    want = sum(max(1, math.ceil(math.ceil(len((r["text"] or "").encode()) / 4) / 100)) for r in d.collect())
    assert len(got) == want
    assert len({(r["bin_id"], r["bin_offset"]) for r in got if r["bin_id"] is not None}) == sum(r["bin_id"] is not None for r in got)
    assert all((r["bin_id"] is None) == (r["n_tokens"] == 0) for r in got)
    assert packing.pack(d.limit(0)).count() == 0


# 3 PII


def test_expectation_maximisation_finds_the_bad_labeler():
    r = np.random.default_rng(1)
    truth = r.integers(0, 2, 4000)  # none or email
    good = lambda p: np.where(r.random(4000) < p, truth, 1 - truth)
    votes = np.stack([good(0.95), good(0.9), good(0.85), good(0.55), np.full(4000, pii.ABSTAIN)], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    post, _, rely = pii.expectation_maximisation(patterns, n.astype(float))
    right = [rely[j, k, k] for j in range(4) for k in (1,)]
    assert right[0] > 0.9 and right[3] < 0.65
    best = {tuple(p): q.argmax() for p, q in zip(patterns, post, strict=True)}
    assert np.mean([best[tuple(v)] == t for v, t in zip(votes, truth, strict=True)]) > 0.93


def test_private_spans(spark):
    r = np.random.default_rng(3)
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    kinds = {
        "email": lambda: f"{r.choice(WORDS)}.{digits(2)}@mail{digits(1)}.example.com",
        "ip": lambda: ".".join(str(x) for x in r.integers(1, 255, 4)),
        "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
        "card": lambda: "4" + digits(15),
        "secret": lambda: 'token = "' + "".join(r.choice(list("0123456789abcdef"), 40)) + '"',
        "none": lambda: f"{r.integers(1, 9)}.0",
    }
    texts, want = [], set()
    for i in range(240):
        kind = list(kinds)[i % 6]
        value, before = kinds[kind](), words(10, i) + " "
        texts.append(before + value + " " + words(8, i + 500))
        if kind == "secret":
            before, value = before + 'token = "', value[9:-1]
        if kind != "none":
            want.add((i, len(before), len(before) + len(value), kind))
    got = {(x["doc_id"], x["span_start"], x["span_end"], x["kind"]) for x in pii.private_spans(docs(spark, *texts)).collect()}
    assert len(got & want) / len(want) > 0.97 and len(got - want) <= 3
    assert pii.private_spans(docs(spark, "nothing here", None, "")).count() == 0


def test_private_spans_of_awkward_tables(spark):
    d = awkward(spark).unionByName(awkward(spark).limit(1).withColumn("text", F.lit("write to ab.12@mail3.example.com " * 3000)))
    assert pii.private_spans(d).where("kind = 'email'").count() == 3000
    assert pii.private_spans(d.limit(0)).count() == 0
    began = time.monotonic()
    for long in ("1" * 100_000, "1-" * 50_000, "1." * 50_000, "a@" * 50_000, "AB12 " * 20_000, "x1=" * 30_000, "a" * 1_000_000 + " 1", "a_" * 500_000 + " @", "A1b" * 100_000, "1" + "a" * 300_000):
        list(pii.candidates(long))
    assert time.monotonic() - began < 10


def test_labelers():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.regex_checksum("DE89370400440532013000", "", "") == "iban"
    assert pii.regex_number("1.2.3.400", "", "") is None and pii.gazetteer_net("127.0.0.1", "", "") == "none"
    assert pii.context_cue("x1", "my password is ", "") == "secret"
    assert [tuple(x) for x in pii.candidates("call +1 (523) 555-1055. or a@b.com!")] == [(5, 22), (27, 34)]


@pytest.mark.parametrize(
    ("value", "kind"),
    [
        *((v, "card") for v in ("4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "3782 822463 10005", "6304 0000 0000 0000 000")),
        *((v, "phone") for v in ("+33 1 23 45 67 89", "01 23 45 67 89", "01.23.45.67.89", "+49 30 123456", "030 1234567", "(030) 123 4567", "+1(017)555-7713", "+1 (017) 555-7713", "+34 612 34 56 78", "612 34 56 78", "912 345 678")),
        *((v, "ip") for v in ("2001:db8::8a2e:370:7334", "2001:0db8:0000:0000:0000:8a2e:0370:7334", "fe80::1", "192.168.100.200")),
    ],
)
def test_values_as_they_are_written_are_one_candidate(value, kind):
    text = f"see {value}, then {value} 3 times"
    assert [text[a:b] for a, b in pii.candidates(text)] == [value, value]
    got = Counter(pii.votes(value, "see ", ", then"))
    assert got[pii.KINDS.index(kind)] >= 1 and not got[0], value


def test_secrets_of_letters_only(spark):
    for text, value in [("password: correcthorse", "correcthorse"), ('my "api_key" = "abcdefghijkl" x', "abcdefghijkl"), ("PWD=p!ss-w0rd.", "p!ss-w0rd"), ("Passwd: say@home99!", "say@home99!")]:
        assert [text[a:b] for a, b in pii.candidates(text)] == [value]
    assert not list(pii.candidates("the secret: it is out; a password is needed, the token of it"))
    texts = [words(12, i) + (" password: " + WORDS[i] + WORDS[i + 1] + "xyzabc" if i % 3 == 0 else f" {i % 9}.0") + " end" for i in range(120)]
    got = {(r["doc_id"], texts[r["doc_id"]][r["span_start"] : r["span_end"]], r["kind"]) for r in pii.private_spans(docs(spark, *texts)).collect()}
    assert got == {(i, WORDS[i] + WORDS[i + 1] + "xyzabc", "secret") for i in range(0, 120, 3)}


def test_rare_kinds_are_trained_on_beside_many_numbers(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE", 60)
    texts = [words(3, i) + f" {i * 7919 % 99991} " + words(3, i + 9000) for i in range(4000)]
    texts += [words(4, i) + f" ssn {i + 101}-45-{i + 6001} " + words(4, i + 90) for i in range(5)]
    got = pii.private_spans(docs(spark, *texts)).collect()
    assert {(r["doc_id"], r["kind"]) for r in got} == {(4000 + i, "ssn") for i in range(5)}


def test_dates_and_times_are_no_phones():
    for value in ("2024-01-05", "01.02.2024", "01-02-2024", "123-45-6789", "1.2.3", "10 20 30"):
        assert pii.regex_shape(value, "", "") != "phone", value
    assert [tuple(x) for x in pii.candidates("at 12:34:56 in std::vector")] == [(3, 5), (6, 8), (9, 11)]


# 4 Exact dedup


def test_counting_quotient_filters_merge_losslessly():
    r = np.random.default_rng(0)
    pool = r.integers(0, 1 << 63, 500).astype(np.uint64)
    parts = [r.choice(pool, 300) for _ in range(4)]
    whole = exact_dedup.CountingQuotientFilter.merge([exact_dedup.CountingQuotientFilter.from_row(*exact_dedup.CountingQuotientFilter.of(p).row()) for p in parts])
    want = Counter(np.concatenate(parts).tolist())
    assert dict(zip(whole.fingerprints().tolist(), whole.counts.tolist(), strict=True)) == want
    assert all(whole.count(f) == n for f, n in list(want.items())[:50]) and whole.count(12345) == 0
    cut = [f for _, f in whole.ranges(3)]
    assert np.concatenate([f.fingerprints() for f in cut]).tolist() == whole.fingerprints().tolist()


def test_exact_duplicates_and_drop(spark):
    d = awkward(spark)
    got = counted(exact_dedup.exact_duplicates(d))
    assert got == Counter({(1, 1, 3): 2, (None, 1, 3): 1})
    kept = exact_dedup.drop_exact_duplicates(d)
    assert kept.columns == d.columns and kept.count() == 7
    assert Counter(r["text"] for r in kept.collect())["same text here"] == 1 and kept.where("text = 'same text here'").head()["doc_id"] == 1
    assert exact_dedup.exact_duplicates(d.limit(0)).count() == 0 and exact_dedup.drop_exact_duplicates(d.limit(0)).count() == 0


# 5 Mixing


def test_rates_meet_the_targets(spark):
    r = np.random.default_rng(4)
    kinds = [("q1t0", "good"), ("q0t0", "junk"), ("q1t1", "rude")]
    texts = [words(int(r.integers(20, 90)), i) + f" {kinds[i % 3][1]} {kinds[i % 3][1]}x" for i in range(300)]
    d = docs(spark, *texts)
    labels = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(200)], LABELS)
    target = {"q1t0": 0.6, "q0t0": 0.3, "q1t1": 0.1}
    domains, w = mixing.fit_classifier(d, labels)
    held = shared.table(mixing.posteriors(d, w, ["doc_id"]), "t")
    steps, got, want = mixing.fit_rates(held, domains, target)
    assert np.abs(got - want).max() / want.sum() < 1e-3
    # brute force: projected gradient on the matrix itself
    p = np.array([x["posterior"] for x in held.orderBy("doc_id").collect()])
    t = np.array([x["tokens"] for x in held.orderBy("doc_id").collect()], float)
    rate = np.ones(len(t))
    scale = 1 / np.linalg.norm(t[:, None] * p, 2) ** 2
    for _ in range(20_000):
        rate = np.maximum(0, rate - scale * (t[:, None] * p) @ ((t * rate) @ p - want))
    assert np.abs((t * rate) @ p - want).max() / want.sum() < 1e-2
    out = mixing.rates(d, labels, target).collect()
    assert len(out) == 300 and min(x["rate"] for x in out) >= 0
    assert np.mean([x["domain"] == kinds[x["doc_id"] % 3][0] for x in out]) > 0.85
    mixed = mixing.mix(d, labels, target)
    assert mixed.columns == d.columns and mixed.count() == sum(x["copies"] for x in out)


def dense_rates(t, p, want, rounds=40_000):
    """Accelerated projected gradient on the whole matrix, restarted where it doesn't descend; rates and objective."""
    a = t[:, None] * p
    scale = t.clip(1)  # the metric of the operator: rates move by the posterior
    step = 1 / np.linalg.eigvalsh((scale[:, None] * p).T @ p)[-1]
    objective = lambda r: ((r @ a - want) ** 2).sum() / 2
    rate = ahead = np.ones(len(t))
    momentum, best = 1.0, objective(rate)
    for _ in range(rounds):
        new = np.maximum(0, ahead - step * (p @ (ahead @ a - want)))
        if (now := objective(new)) > best:
            ahead, momentum = rate, 1.0
            continue
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / following * (new - rate)
        rate, momentum, best = new, following, now
    return rate, best


@pytest.mark.parametrize(("seed", "domains", "sharp"), [(1, 2, 1.0), (2, 4, 1.0), (3, 4, 0.5), (4, 3, 3.0), (5, 4, 8.0)])
def test_rates_equal_dense_projected_gradient(spark, seed, domains, sharp):
    """Targets that posteriors far from certain can't meet, and some they can: the objective is the dense one's."""
    r = np.random.default_rng(seed)
    logit = sharp * r.normal(size=(400, domains))
    p = np.exp(logit) / np.exp(logit).sum(axis=1, keepdims=True)
    t = r.integers(1, 500, 400)
    names = [f"d{i}" for i in range(domains)]
    share = dict(zip(names, [0.97] + [0.03 / (domains - 1)] * (domains - 1), strict=True))
    held = spark.createDataFrame([(int(n), q.tolist()) for n, q in zip(t, p, strict=True)], "tokens long, posterior array<double>").coalesce(2).cache()
    steps, got, want = mixing.fit_rates(held, names, share)
    rate = mixing.replay(p, steps)
    assert rate.min() >= 0 and np.allclose((t * rate) @ p, got)
    _, best = dense_rates(t.astype(float), p, want)
    mine = ((got - want) ** 2).sum() / 2
    start = ((t @ p - want) ** 2).sum() / 2
    assert mine - best <= 1e-4 * start


def test_mixing_of_awkward_tables(spark):
    d = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, 0)], LABELS)
    assert mixing.rates(d, labels).count() == d.count()
    assert all(x["rate"] == 1 for x in mixing.rates(d, labels).where("tokens = 0").collect())
    assert mixing.mix(d, labels.limit(0)).columns == d.columns
    assert mixing.rates(d.limit(0), labels).count() == 0 and mixing.mix(d.limit(0), labels).count() == 0


# 6 WARC


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/1", "<p>x</p>" * 50), (2, "http://a/2", ""), (3, None, "x"), (4, "http://a/4", None), (5, "http://ä/5", "é" * 100_000), (6, "http://a/\r\nX: y", "z"), (1, "http://a/1", "<p>x</p>" * 50)], "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert Counter((r["target_uri"], r["payload"].decode()) for r in got) == Counter((p["url"].replace("\r\n", "%0D%0A"), p["html"]) for p in pages.collect() if p["url"] and p["html"] is not None)
    assert all(r["error"] is None and r["digest_ok"] and r["content_length"] == len(r["payload"]) for r in got)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_rules():
    import zstandard

    sample = [warc.record("resource", f"http://x/{i}", "2024-01-01T00:00:00Z", "0" * 8, words(60, i).encode()) for i in range(300)]
    dictionary = zstandard.train_dictionary(4096, sample).as_bytes()
    press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    good = [press.compress(s) for s in sample[:3]]
    for packed in (True, False):
        found = list(warc.records(warc.dictionary_frame(dictionary, packed) + b"".join(good)))
        assert [f["error"] for f in found] == [None] * 3 and found[1]["payload"] == words(60, 1).encode()
    errors = {
        "headers do not end": b"WARC/1.1\r\nA: b",
        "not a WARC version line": sample[0].replace(b"WARC/1.1", b"HTTP/1.1", 1),
        "missing: warc-date": sample[0].replace(b"WARC-Date", b"X-Date", 1),
        "Content-Length is not a number": sample[0].replace(b"Content-Length: ", b"Content-Length: x", 1),
        "of": sample[0].replace(b"Content-Length: ", b"Content-Length: 9", 1),
        "two line ends": sample[0] + b"!",
        "digest differs": sample[0].replace(words(60, 0).encode()[:3], b"###", 1),
        "more than one record": sample[0] + sample[1],
    }
    for why, record in errors.items():
        (found,) = warc.records(press.compress(record).join([warc.dictionary_frame(dictionary), b""]))
        assert why in found["error"], (why, found["error"])
    broken = list(warc.records(warc.dictionary_frame(dictionary) + good[0] + good[1][:6] + b"\xff" * 20 + good[2]))
    assert broken[0]["error"] is None and broken[1]["error"] and broken[-1]["error"] is None
    assert "dictionary" in next(warc.records(struct.pack("<II", warc.DICTIONARY_MAGIC, 99) + b"x"))["error"]
    assert "skippable" in list(warc.records(warc.dictionary_frame(dictionary) + good[0] + struct.pack("<II", 0x184D2A51, 99) + b"x"))[-1]["error"]
    plain = zstandard.ZstdCompressor(write_checksum=True, write_content_size=False)
    for size in (0, 1, 300_000, 3_000_000):  # with a checksum, without a size, of several blocks
        whole = warc.record("resource", "http://x", "2024-01-01T00:00:00Z", "0" * 8, np.random.default_rng(size).integers(0, 255, size).astype(np.uint8).tobytes())
        pieces = plain.compressobj()
        packed = pieces.compress(whole) + pieces.flush()
        assert warc.frame_end(memoryview(packed + b"rest"), 0) == len(packed)
        assert [f["error"] for f in warc.records(packed * 2)] == [None, None]
    (swollen,) = warc.records(zstandard.ZstdCompressor().compress(bytes(50_000_000)), most=10_000_000)
    assert "a record of over" in swollen["error"]
    assert list(warc.records(b"")) == []


# 7 Near dedup


def brute_jaccard(x, y):
    out = 0.0
    for i in set(x) & set(y):
        out += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y))
    return out


def weighted(c):
    keys = np.array(sorted(c), np.uint64)
    return keys, np.array([c[int(k)] for k in keys])


def test_probability_jaccard_and_signatures():
    r = np.random.default_rng(5)
    for _ in range(20):
        x, y = (Counter(r.integers(1, 30, 40).tolist()) for _ in range(2))
        assert near_dedup.probability_jaccard(*weighted(x), *weighted(y)) == pytest.approx(brute_jaccard(x, y))
    agree, want = [], []
    for _ in range(60):
        pool = r.integers(1, 1 << 62, 60)
        x, y = (Counter(r.choice(pool, 80).tolist()) for _ in range(2))
        (a, n), (b, m) = weighted(x), weighted(y)
        s = near_dedup.signatures(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]), np.concatenate([n, m]))
        agree.append((s[0] == s[1]).mean())
        want.append(brute_jaccard(x, y))
    assert abs(np.mean(agree) - np.mean(want)) < 0.02


def test_near_duplicate_groups(spark):
    base = [words(120, i) for i in range(30)]
    texts = [*base, *[b.replace(b.split()[50], "zzzz", 1) for b in base[:10]], *[base[0] + f" tail{i}" for i in range(40)], words(2, 5), words(2, 5)]
    got = near_dedup.near_duplicate_groups(docs(spark, *texts))
    groups = defaultdict(set)
    for r in got.collect():
        groups[r["group_id"]].add(r["doc_id"])
    assert groups[0] == {0, 30, *range(40, 80)} and groups[80] == {80, 81}
    assert all(groups[i] == {i, 30 + i} for i in range(1, 10)) and len(groups) == 11
    kept = {r["doc_id"] for r in near_dedup.drop_near_duplicates(docs(spark, *texts)).collect()}
    assert kept == {*range(30), 80}


def test_near_duplicates_of_one_original_match_brute_force(spark):
    """Copies edited independently: like their original (J about 0.6), mostly unlike each other."""
    r = np.random.default_rng(21)
    texts = []
    for seed in (1, 2):
        base = words(120, 7000 + seed).split()
        texts.append(" ".join(base))
        for i in range(300):
            copy = list(base)
            for at in r.choice(120, 9, replace=False):
                copy[at] = f"edit{seed}x{i}x{at}"
            texts.append(" ".join(copy))
    raw = [t.encode() for t in texts]
    w = textbuf.Words(np.concatenate([[0], np.cumsum([len(t) for t in raw])]), np.frombuffer(b"".join(raw), np.uint8))
    bounds, h, n = near_dedup.profiles(*textbuf.shingles(w, near_dedup.SHINGLE), len(texts))
    keys = near_dedup.bands(near_dedup.signatures(bounds, h, n))
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in np.flatnonzero((keys[:i] == keys[i]).any(axis=1)):
            x, y = slice(bounds[i], bounds[i + 1]), slice(bounds[j], bounds[j + 1])
            if top[i] != top[j] and near_dedup.probability_jaccard(h[x], n[x], h[y], n[y]) >= near_dedup.THRESHOLD:
                a, b = top[i], top[j]
                top = [min(a, b) if t in (a, b) else t for t in top]
    want = {(i, t) for i, t in enumerate(top) if top.count(t) > 1}
    assert len(want) > 590
    assert {(r["doc_id"], r["group_id"]) for r in near_dedup.near_duplicate_groups(docs(spark, *texts)).collect()} == want


def test_near_dedup_of_awkward_tables(spark):
    d = awkward(spark)
    kept = near_dedup.drop_near_duplicates(d)
    assert kept.columns == d.columns and kept.count() == 7 and kept.where("text = 'same text here'").count() == 1
    assert counted(near_dedup.near_duplicate_groups(d).select("doc_id", "group_id", "group_size")) == Counter({(1, 1, 3): 2, (None, 1, 3): 1})
    assert near_dedup.near_duplicate_groups(d.limit(0)).count() == 0 and near_dedup.drop_near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 40, (25, 2))] + [(i, i + 1) for i in range(100, 130)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["label"] for x in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


# 8 Language ID


def test_language_id_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 60")
    train, held = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    got = langid.identify(held, langid.fit(train)).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["language"] == r["lang"] for r in got]) > 0.97 and np.mean([r["rejected"] for r in got]) < 0.02


def test_language_id_of_awkward_tables(spark):
    d = awkward(spark)
    model = langid.fit(d)
    got = {(r["doc_id"], r["language"] == "und", r["rejected"]) for r in langid.identify(d, model).collect()}
    assert {(2, True, True), (3, True, True), (4, True, True), (None, True, True)} <= got
    kept = langid.keep_identified(d, model)
    assert kept.columns == d.columns and kept.where("text IS NULL OR trim(text) = ''").count() == 0
    assert langid.fit(d.limit(0)) is None and langid.identify(d, None).where("NOT rejected").count() == 0
    assert langid.identify(d.limit(0), model).count() == 0


# 9 Suffix arrays


def brute_spans(texts, n=suffix_dedup.LONG):
    seen = defaultdict(set)
    split = [(t or "").split() for t in texts]
    for i, w in enumerate(split):
        for p in range(len(w) - n + 1):
            seen[tuple(w[p : p + n])].add(i)
    out = set()
    for i, w in enumerate(split):
        cover = [False] * (len(w) + 1)
        for p in range(len(w) - n + 1):
            if len(seen[tuple(w[p : p + n])]) > 1:
                cover[p : p + n] = [True] * n
        start = None
        for p, c in enumerate(cover):
            if c and start is None:
                start = p
            if not c and start is not None:
                out.add((i, start, p))
                start = None
    return out


def passages():
    passage, other = words(70, 999), words(51, 998)
    return [words(90, 1) + " " + passage + " " + words(40, 2), passage, words(30, 3) + " " + passage + " " + other, other + " " + words(60, 4), words(49, 5), words(49, 5), words(50, 6), words(50, 6), "la " * 300, words(80, 7) * 1, (words(60, 8) + " ") * 3, None, "", "la " * 70, words(230, 9), words(20, 10) + " " + words(230, 9), words(60, 8)]


@pytest.mark.parametrize("long", [20, 50, 200])
def test_repeated_passages_match_brute_force(spark, long):
    texts = passages()
    got = {(r["doc_id"], r["span_start"], r["span_end"]) for r in suffix_dedup.repeated_passages(docs(spark, *texts), long).collect()}
    assert got == brute_spans(texts, long)


def test_hot_anchors_match_brute_force(spark, monkeypatch):
    texts = passages()
    want = sorted(map(tuple, suffix_dedup.repeated_passages(docs(spark, *texts)).collect()))
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    assert sorted(map(tuple, suffix_dedup.repeated_passages(docs(spark, *texts)).collect())) == want


@pytest.mark.parametrize("long", [20, 50])
def test_batches_added_to_a_stored_index_match_brute_force(spark, tmp_path, long):
    texts = passages()
    for k in range(0, len(texts), 5):
        index = suffix_dedup.PassageIndex(spark, f"file://{tmp_path}/index", shards=3, long=long)
        part = [t for t in texts[k : k + 5]]
        index.add(docs(spark, *part, ids=list(range(k, k + len(part)))))
        got = {(r["doc_id"], r["span_start"], r["span_end"]) for r in index.spans().collect()}
        assert got == brute_spans(texts[: k + 5], long), k
        sizes = defaultdict(list)
        for r in index.levels().select("shard", "size").collect():
            sizes[r["shard"]].append(r["size"])
        assert all(a >= 2 * b for v in sizes.values() for a, b in zip(sorted(v)[::-1], sorted(v)[-2::-1], strict=False))


def test_suffix_order_and_places_match_brute_force():
    r = np.random.default_rng(7)

    def windows(k):
        n = r.integers(1, 5, k)
        text = [r.integers(1, 4, m + 5).astype(np.uint32) for m in n]
        return suffix_dedup.Level.of(r.integers(0, 6, k), np.zeros(k, np.int64), n, np.concatenate(text), 6)

    def seen(v):
        return [tuple(v.text[a:e].tolist()) for a, e in zip(v.at, v.end, strict=True)]

    def agree(x, y):
        return next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))

    for _ in range(20):
        x, y = windows(int(r.integers(1, 30))), windows(int(r.integers(1, 30)))
        for v in (x, y):
            assert seen(v) == sorted(seen(v)) and v.lcp[1:].tolist() == [agree(p, q) for p, q in zip(seen(v), seen(v)[1:], strict=False)]
        place, left, right = x.locate(y)
        both = seen(x)
        for s, at, lo, hi in zip(seen(y), place, left, right, strict=True):
            assert at == sum(t <= s for t in both)
            assert lo == (agree(both[at - 1], s) if at else 0) and hi == (agree(both[at], s) if at < len(both) else 0)
        merged = x.merge(y)
        assert seen(merged) == sorted(seen(x) + seen(y)) and merged.lcp[1:].tolist() == [agree(p, q) for p, q in zip(seen(merged), seen(merged)[1:], strict=False)]


def test_family_levels_stay_logarithmic_and_exact():
    r = np.random.default_rng(2)
    family, held = suffix_dedup.Family(long=4), []
    for k in range(60):
        n = r.integers(1, 4, 12)
        text = [r.integers(1, 5, m + 3).astype(np.uint32) for m in n]
        doc = r.integers(0, 50, 12)
        word = np.arange(12, dtype=np.int64) * 10 + 1000 * k
        family.add(suffix_dedup.Level.of(doc, word, n, np.concatenate(text), 4))
        held += [(tuple(t[i : i + 4].tolist()), int(d), int(w) + i) for t, d, w, m in zip(text, doc, word, n, strict=True) for i in range(m)]
        assert len(family.levels) <= 2 + np.log2(1 + k)
        assert all(len(a) >= 2 * len(b) for a, b in zip(family.levels, family.levels[1:], strict=False))
    by = defaultdict(set)
    for name, d, _ in held:
        by[name].add(d)
    want = {w: min(by[name] - {d}) for name, d, w in held if by[name] - {d}}
    got = {int(w): int(o) for v in family.levels for w, o in zip(v.word, v.other, strict=True) if o != suffix_dedup.NOBODY}
    assert got == want


def test_repeated_passages_of_awkward_tables(spark):
    d = awkward(spark)
    assert suffix_dedup.repeated_passages(d).count() == 0 and suffix_dedup.repeated_passages(d.limit(0)).count() == 0
    twice = d.unionByName(d.where("doc_id = 5"))
    assert counted(suffix_dedup.repeated_passages(twice)) == Counter({(5, 0, 60_000, 60_000, 5): 2})


# 10 Nearest neighbours


def test_nearest_recall(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(700, 24)).astype(np.float32)
    x[350:360] = x[:10]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = defaultdict(dict)
    for row in ann.nearest(df, k=10, rerank=60).collect():
        got[row["vec_id"]][row["neighbour_id"]] = row["distance"]
    far = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    true = np.argsort(far, axis=1, kind="stable")[:, :10]
    assert np.mean([len(set(got[i]) & set(true[i].tolist())) / 10 for i in range(700)]) >= 0.95
    assert got[0][350] == 0 and all(got[i][j] == pytest.approx(far[i, j]) for i in (0, 5) for j in got[i])


def test_nearest_in_clusters_is_exact(spark):
    r = np.random.default_rng(16)
    x = r.normal(size=(1200, 16)).astype(np.float32)
    for i, spread in enumerate((0.0, 0.02, 0.1)):
        x[100 + 300 * i : 400 + 300 * i] = r.normal(size=16) + spread * r.normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    got = defaultdict(list)
    for row in ann.nearest(df, k=10, rerank=20).orderBy("vec_id", "rank").collect():
        got[row["vec_id"]].append(row["neighbour_id"])
    far = ((x[:, None].astype(float) - x[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    true = np.argsort(far, axis=1, kind="stable")[:, :10]
    assert [got[i] for i in range(len(x))] == true.tolist()


def test_cells_are_few_for_clusters_and_recall_holds(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 100)
    r = np.random.default_rng(26)
    x = (r.normal(size=(40, 16))[r.integers(0, 40, 3000)] * 3 + 0.3 * r.normal(size=(3000, 16))).astype(np.float32)
    x[100:1100] = x[7]  # a third are copies
    centres, probes = ann.partition(x[::2], 30)
    assert len(centres) == 30 and probes < 10
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    found = ann.nearest(df, queries=F.col("vec_id") % 20 == 0)
    got = defaultdict(list)
    for row in found.orderBy("vec_id", "rank").collect():
        got[row["vec_id"]].append((row["neighbour_id"], row["distance"]))
    assert set(got) == set(range(0, 3000, 20)) and all(len(v) == 10 for v in got.values())
    far = np.sqrt(((x[::20, None].astype(float) - x[None]) ** 2).sum(2))
    far[np.arange(150), np.arange(0, 3000, 20)] = np.inf
    right = [sum(d <= np.sort(far[i // 20])[9] + 1e-9 for _, d in got[i]) for i in got]
    assert np.mean(right) / 10 >= 0.95
    assert [j for j, _ in got[200]] == [7, *range(100, 109)] and [j for j, _ in got[100]] == [7, *range(101, 110)]


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_on_many_vectors(spark, clustered):
    r = np.random.default_rng(36)
    x = r.normal(size=(13_000, 32)) if not clustered else r.normal(size=(60, 32))[r.integers(0, 60, 13_000)] * 2 + 0.5 * r.normal(size=(13_000, 32))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for row in ann.nearest(df, queries=F.col("vec_id") % 100 == 0).collect():
        got[row["vec_id"]].add(row["neighbour_id"])
    far = ((x[::100] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[::100].astype(float) @ x.T)
    far[np.arange(130), np.arange(0, 13_000, 100)] = np.inf
    assert np.mean([len(got[i] & set(np.argsort(far[i // 100])[:10].tolist())) / 10 for i in got]) >= 0.9


def test_beam_search_beats_greedy():
    x = np.random.default_rng(8).normal(size=(600, 16)).astype(np.float32)
    q = ann.train(x, books=4, words=16)
    error = [((x - q.decode(q.encode(x, beam))) ** 2).sum() for beam in (1, 8)]
    assert error[1] < error[0] < (x**2).sum()


def test_nearest_of_awkward_tables(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, None), (3, []), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("mine"))
    got = counted(ann.nearest(df).select("vec_id", "rank", "neighbour_id"))
    assert got == Counter({(1, 1, 1): 2, (1, 2, None): 2, (None, 1, 1): 1, (None, 2, 1): 1})
    assert ann.nearest(df.limit(0)).count() == 0


# Pipeline


def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    kept, before = source, source.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = shared.table(stage(spark, kept, SF), name)
        assert kept.columns == source.columns
        if name == "exact_dedup":
            assert kept.count() == kept.select("text").distinct().count()
        if name in ("language_id", "mixing"):
            assert kept.count() > 0.5 * before or name == "mixing"
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.where("piece = 0").count() == kept.count()
    assert packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > packing.CAPACITY).count() == 0


def test_softmax_regression():
    r = np.random.default_rng(9)
    y = r.integers(0, 3, 600)
    bounds, feature = np.arange(0, 1201, 2), np.stack([y * 10 + r.integers(0, 5, 600), 100 + r.integers(0, 50, 600)], 1).ravel()
    w = linear.fit(bounds, feature, np.eye(3)[y], dim=200)
    assert (linear.scores(bounds, feature, w).argmax(1) == y).mean() > 0.98
