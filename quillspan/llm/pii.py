"""Personal data and secrets by weak supervision.

Candidate spans are found with two wide patterns: anything with a digit or an @,
and what is assigned to the name of a secret (``password: ...``), of any letters.
Labelers of three sorts vote on each: strict regular expressions, gazetteers (mail
and network tables, issuer prefixes, dialling codes) and context (words around the
span, names of secrets). Names of persons aren't covered, nor are secrets without a
digit or @ that no ``:`` or ``=`` ties to such a name. A vote is
a kind, ``none`` or an abstention. Expectation-maximisation over the counts of
all vote patterns in the corpus estimates each labeler's reliability per kind and
every pattern's posterior; a softmax classifier on span and context features is
then trained on the posteriors and decides each span.

The classifier is trained on all candidates, alike ones (votes and features) as one
with their number as weight. Of a likeliest kind with more than ``SAMPLE`` such rows
about so many are taken by hash, and stand for the others by weight, so that no kind
is thinned by the number of another. Votes, reliabilities and decisions cover every
candidate of every text.

Defined results: null and empty texts have no spans; equal texts have equal
spans, repeated rows each their own; a table without candidates, or an empty one,
gives an empty result; a mail address has at most 64 characters before its @, as the
standard says; labelers see ``BEFORE`` characters before a span and ``AFTER`` behind it;
overlapping candidates can't occur; ties go to the kind
first in ``KINDS``; a null ``doc_id`` is kept; further columns are ignored.
"""

from __future__ import annotations

import ipaddress
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import linear, shared

KINDS = ("none", "email", "ip", "phone", "card", "secret", "ssn", "iban")
#: Distinct candidates of each kind that the classifier is trained on, about.
SAMPLE = 20_000
DIM = 1 << 14
#: Lowest posterior that makes a span of a kind.
LEAST = 0.5
ROUNDS = 60
#: Characters around a span that labelers and features see.
BEFORE, AFTER = 40, 10

CANDIDATE = re.compile(
    r"""(?<![\w.+%-])[\w.+%-]{1,64}+@(?:[\w-]{1,63}\.)+[A-Za-z]{2,24}"""
    r"""|\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b"""
    r"""|(?<!\d)(?:\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{3})?|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)"""
    r"""|(?<![\w:])(?=[A-Fa-f:]{0,39}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:])"""
    r"""|\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)"""
    r"""|\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d|\.\d)"""
    r"""|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d|\.\d)"""
    r"""|(?:\(\d{2,5}\)[ .-]?|(?<!\d)\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d|\.\d)"""
    r"""|(?<!\d)0\d{1,4}(?:(?:[ .-]\d{2,4}){2,4}|[ /-]\d{5,8})(?!\d|\.\d)"""
    r"""|\(0\d{1,4}\)[ .-]?\d{2,8}(?:[ .-]?\d{2,4}){0,3}(?!\d|\.\d)"""
    r"""|(?<!\d)[6-9]\d\d(?:[ .-]\d\d){3}(?!\d|\.\d)"""
    r"""|(?<![A-Za-z_/+=.-])[A-Za-z_/+=.-]*+\d[A-Za-z0-9_/+=.-]*+"""  # begins only where a run of letters does: linear in the text
)
#: What a secret is assigned to, and the secret.
_SECRET_NAME = r"(?:password|passwd|passphrase|passcode|pwd|secret|token|bearer|credentials?|(?:api|access|secret|private|auth)[_-]?key)"
ASSIGNED = re.compile(rf"""(?i:(?<![A-Za-z]){_SECRET_NAME})["']?[ \t]{{0,3}}(?::=|=>|[:=])[ \t]{{0,3}}["']?([^\s"',;&<>()\[\]{{}}]{{6,200}})""")
_ASSIGNS = re.compile(rf"""(?i:(?<![A-Za-z]){_SECRET_NAME})["']?[ \t]{{0,3}}(?::=|=>|[:=])[ \t]{{0,3}}["']?\Z""")
_ANY = re.compile(r"[0-9@:=]")
_WORD = re.compile(r"\w+")

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}\Z")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}\Z")
#: With a country's code, or nine to twelve digits apart as they are written within a country.
_ABROAD = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}\Z")
_NATIONAL = re.compile(r"(?:\(0\d{1,4}\)|0\d{1,4}|[6-9]\d\d(?=(?:[ .-]\d\d){3}\Z|(?:[ .-]\d{3}){2}\Z))(?:[ ./-]?\d{2,8}){1,4}\Z")
_HEX = re.compile(r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})\Z")
_KEY = re.compile(r"(?:sk|pk|ghp|gho|xox[abp]|AKIA|AIza|eyJ)[A-Za-z0-9_\-.]{14,}\Z")
_IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}\Z")
_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}\Z")

TOP_LEVEL = frozenset("com org net edu gov mil int info biz io ai dev app co uk de fr es it nl be ch at pl se no dk fi ie pt eu us ca mx br ar cl jp cn in au nz kr ru tr za example test".split())
MAIL_HOSTS = ("example.", "mail", "gmail", "yahoo", "outlook", "hotmail", "proton", "icloud", "gmx", "web.de", "orange", "free.fr")
DIALLING = ("+1", "+44", "+49", "+33", "+34", "+39", "+31", "+41", "+43", "+81", "+86", "+91", "+55", "+52")
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "2720", "34", "37", "6011", "65", "35", "36", "38")
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "CH": 21, "AT": 20, "PL": 28, "PT": 25, "IE": 22}
CUES = {
    "email": frozenset("email mail e-mail correo courriel contact contacto kontakt".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax whatsapp telefon teléfono téléphone".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta".split()),
    "ip": frozenset("ip host server address addr ipv4 gateway".split()),
    "secret": frozenset("token key secret password passwd pwd apikey api_key access_key bearer credential".split()),
    "ssn": frozenset("ssn social security".split()),
    "iban": frozenset("iban account konto compte cuenta".split()),
}
_K = {k: i for i, k in enumerate(KINDS)}
ABSTAIN = len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def regex_shape(s: str, before: str, after: str) -> str | None:
    if _EMAIL.match(s):
        return "email"
    if _SSN.match(s):
        return "ssn"
    if _PHONE.match(s):
        return "phone" if not s.isdigit() else None
    if _ABROAD.match(s) and 8 <= len(_digits(s)) <= 15 or _NATIONAL.match(s) and not s.isdigit() and 9 <= len(_digits(s)) <= 12:
        return "phone"
    if _IBAN.match(s.replace(" ", "")):
        return "iban"
    if _HEX.match(s) and not s.isdigit() or _KEY.match(s):
        return "secret"
    return None


def _ip6(s: str) -> bool:
    if s.count(":") < 2:
        return False
    try:
        return bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def regex_number(s: str, before: str, after: str) -> str | None:
    if _ip6(s):
        return "ip"
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() and p == str(int(p)) and int(p) < 256 for p in parts):
        return "ip"
    d = _digits(s)
    if len(d) == len(s.replace(" ", "").replace("-", "")) and 13 <= len(d) <= 19:
        return "card"
    return "none" if s.isdigit() and len(s) < 7 else None


def regex_checksum(s: str, before: str, after: str) -> str | None:
    d = _digits(s)
    if len(d) == len(s.replace(" ", "").replace("-", "")) and 13 <= len(d) <= 19 and luhn(d):
        return "card"
    packed = s.replace(" ", "")
    if _IBAN.match(packed):
        turned = packed[4:] + packed[:4]
        return "iban" if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 else "none"
    return None


def gazetteer_net(s: str, before: str, after: str) -> str | None:
    if "@" in s:
        host = s.rpartition("@")[2].lower()
        return "email" if host.rpartition(".")[2] in TOP_LEVEL or any(h in host for h in MAIL_HOSTS) else "none"
    if s.count(".") == 3 or s.count(":") > 1:
        try:
            ip = ipaddress.ip_address(s)
        except ValueError:
            return "none"
        return "none" if ip.is_loopback or ip.is_unspecified or ip.is_multicast and s.endswith(".0") else "ip"
    return None


def gazetteer_numbers(s: str, before: str, after: str) -> str | None:
    if s.startswith("+"):
        return "phone" if s.startswith(DIALLING) else None
    d = _digits(s)
    if 13 <= len(d) <= 19 and len(d) == len(s.replace(" ", "").replace("-", "")):
        return "card" if d.startswith(ISSUERS) else None
    packed = s.replace(" ", "")
    if packed[:2] in IBAN_LENGTHS and _IBAN.match(packed):
        return "iban" if IBAN_LENGTHS[packed[:2]] == len(packed) else "none"
    return None


def context_cue(s: str, before: str, after: str) -> str | None:
    for word in reversed(_WORD.findall(before.lower())[-3:]):
        for kind, cues in CUES.items():
            if word in cues:
                return kind
    return None


def context_marks(s: str, before: str, after: str) -> str | None:
    if _ASSIGNS.search(before):
        return "secret"
    left = before.rstrip(" ")
    if left[-1:] in ('"', "'") and left[:-1].rstrip(" ")[-1:] in ("=", ":") and len(s) >= 12:
        return "secret"
    if left[-1:] in ("$", "€", "£", "#", "§") or after[:1] in ("%", "°"):
        return "none"
    return None


def context_shape(s: str, before: str, after: str) -> str | None:
    """Short numbers and words with a digit amid running text are mostly nothing."""
    d = _digits(s)
    if _ASSIGNS.search(before):
        return None
    if "@" not in s and s.count(".") != 3 and s.count(":") < 2 and len(d) <= 6 and len(s) < 20:
        return "none"
    if (len(d) in (10, 11) or 8 <= len(d) <= 15 and s[:1] == "+") and s[:1] in "+(":
        return "phone"
    return None


LABELERS = (regex_shape, regex_number, regex_checksum, gazetteer_net, gazetteer_numbers, context_cue, context_marks, context_shape)


def _trimmed(text: str, lo: int, hi: int) -> tuple[int, int]:
    while hi > lo and text[hi - 1] in ".-/=+_":
        hi -= 1
    while lo < hi and text[lo] in ".-/=_":
        lo += 1
    return lo, hi


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the candidate spans in characters, in order; a secret's value stands for the candidates within it."""
    if not _ANY.search(text):
        return
    found = [b for m in CANDIDATE.finditer(text) if (b := _trimmed(text, *m.span()))[1] - b[0] > 1]
    at = 0
    for lo, hi in [b for m in ASSIGNED.finditer(text) if (b := _trimmed(text, *m.span(1)))[1] - b[0] > 1]:
        while at < len(found) and found[at][1] <= lo:
            yield found[at]
            at += 1
        end = at
        while end < len(found) and found[end][0] < hi:
            end += 1
        if all(lo <= a and b <= hi for a, b in found[at:end]):
            yield lo, hi
            at = end
    yield from found[at:]


def votes(s: str, before: str, after: str) -> bytes:
    """One byte a labeler."""
    out = []
    for f in LABELERS:
        v = f(s, before, after)
        out.append(ABSTAIN if v is None else _K[v])
    return bytes(out)


def features(s: str, before: str, after: str) -> list[int]:
    """Hashed features of a span and its surroundings."""
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d", "9", s)))
    runs = re.sub(r"9+", "9", shape)
    words = _WORD.findall(before.lower())[-2:]
    d = _digits(s)
    marks = [f"shape {shape[:40]}", f"runs {runs[:40]}", f"length {min(len(s), 64)}", f"digits {min(len(d), 64)}", f"share {round(4 * len(d) / len(s))}", f"before {before[-1:]}", f"after {after[:1]}", f"at {'@' in s}", f"dots {min(s.count('.'), 5)}", f"luhn {len(d) > 12 and luhn(d)}", f"hex {bool(_HEX.match(s))}", f"plus {s[:1] == '+'}", f"parens {'(' in s}", f"assigned {bool(_ASSIGNS.search(before))}", *(f"word {w}" for w in words), *(f"cue {k}" for k, c in CUES.items() if any(w in c for w in words))]
    return sorted({zlib.crc32(m.encode()) % DIM for m in marks})


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dawid and Skene's model: posterior of each pattern, kinds' shares, reliabilities (labeler, kind, vote)."""
    n, labelers = patterns.shape
    kinds = len(KINDS)
    # At first every vote is believed, and a pattern without votes is nothing.
    post = np.full((n, kinds), 0.02)
    post[:, 0] += 0.05
    for j in range(labelers):
        voted = patterns[:, j] < kinds
        post[np.flatnonzero(voted), patterns[voted, j]] += 1
    post /= post.sum(axis=1, keepdims=True)
    share, rely = None, None
    for _ in range(rounds):
        mass = post * counts[:, None]
        share = (mass.sum(axis=0) + 1) / (counts.sum() + kinds)
        rely = np.full((labelers, kinds, kinds + 1), 0.02)
        rely[:, np.arange(kinds), np.arange(kinds)] += 1.0  # a labeler is right more often than not
        rely[:, :, ABSTAIN] += 0.5
        for j in range(labelers):
            for v in range(kinds + 1):
                rely[j, :, v] += mass[patterns[:, j] == v].sum(axis=0)
        rely /= rely.sum(axis=2, keepdims=True)
        log = np.log(share)[None] + sum(np.log(rely[j][:, patterns[:, j]]).T for j in range(labelers))
        new = linear.softmax(log)
        moved = float(np.abs(new - post).max())
        post = new
        if moved < 1e-6:
            break
    return post, share, rely


def _spans(docs: DataFrame) -> DataFrame:
    """``doc_id, lo, hi, votes, feature`` of every candidate; the values themselves aren't passed on."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "lo", "hi", "votes", "feature"]

    def run(batches):
        for batch in batches:
            held: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for lo, hi in candidates(text) if text else ():
                    s, before, after = text[lo:hi], text[max(0, lo - BEFORE) : lo], text[hi : hi + AFTER]
                    held.append((i, lo, hi, votes(s, before, after), features(s, before, after)))
            if held:
                i, lo, hi, v, f = zip(*held, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(v, pa.binary()), pa.array(f, pa.list_(pa.int32()))], names)

    return docs.where(F.col("text").rlike("[0-9@:=]")).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lo int, hi int, votes binary, feature array<int>")


def _training(spans: DataFrame, patterns: np.ndarray, posterior: np.ndarray) -> DataFrame:
    """``votes, feature, n`` in a fixed order: distinct candidates, and how many each stands for."""
    kinds = spans.sparkSession.createDataFrame([(bytearray(p.astype(np.uint8)), int(k)) for p, k in zip(patterns, posterior.argmax(axis=1), strict=True)], "votes binary, kind int")
    rows = shared.table(spans.groupBy("votes", "feature").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(kinds), "votes"), "training")
    luck = F.pmod(F.xxhash64("votes", "feature"), F.lit(1_000_003)) / F.lit(1_000_003)
    share = F.lit(1.0)
    for r in rows.groupBy("kind").count().collect():
        share = F.when(F.col("kind") == r["kind"], F.lit(min(1.0, SAMPLE / r["count"]))).otherwise(share)
    return rows.withColumn("share", share).where(luck <= F.col("share")).select("votes", "feature", (F.col("n") / F.col("share")).alias("n")).orderBy("votes", "feature")


def private_spans(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, span_start, span_end, kind, probability`` of every span that isn't ``none``."""
    spark = docs.sparkSession
    spans = shared.table(_spans(docs), "spans")
    seen = spans.groupBy("votes").count().toArrow().to_pydict()  # at most (kinds + 1) ** labelers patterns, of which few occur
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, span_start int, span_end int, kind string, probability double"
    if not seen["votes"]:
        return spark.createDataFrame([], schema)
    order = np.argsort([bytes(v) for v in seen["votes"]])
    patterns = np.array([list(seen["votes"][k]) for k in order])
    counts = np.array([seen["count"][k] for k in order], np.float64)
    posterior, _, _ = expectation_maximisation(patterns, counts)
    by_pattern = {bytes(p.astype(np.uint8)): q for p, q in zip(patterns, posterior, strict=True)}
    sample = _training(spans, patterns, posterior).toArrow().to_pydict()
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in sample["feature"]])]).astype(np.int64)
    target = np.array([by_pattern[bytes(v)] for v in sample["votes"]])
    alike = np.array(sample["n"], np.float64)
    # Rare kinds count as much as common ones, up to a point.
    weight = alike * (target / np.sqrt(np.maximum((alike[:, None] * target).sum(axis=0), 1))).sum(axis=1)
    w = linear.fit(bounds, np.concatenate([np.asarray(f, np.int64) for f in sample["feature"]]), target, weight, dim=DIM, steps=200, l2=1e-5)
    sent = spark.sparkContext.broadcast(w)

    def decide(batches):
        for batch in batches:
            lists = batch.column(3)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            p = linear.softmax(linear.scores(at, lists.flatten().to_numpy().astype(np.int64), sent.value))
            best = p.argmax(axis=1)
            sure = p[np.arange(len(p)), best]
            keep = np.flatnonzero((best > 0) & (sure >= least))
            part = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([KINDS[k] for k in best[keep]], pa.string()), pa.array(sure[keep].round(6), pa.float64())], ["doc_id", "span_start", "span_end", "kind", "probability"])

    return spans.select("doc_id", "lo", "hi", "feature").mapInArrow(decide, schema)
