"""Query compilation: filters, requests, guards."""
