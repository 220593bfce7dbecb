"""Personal data: patterns propose spans, checksum validators confirm them, words nearby adjust the score.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``: leftmost non-overlapping matches of each kind's pattern, of which
those that fail the kind's check are dropped without a retry. They are always reported, with their scores. The other kinds
(``iban``, ``amex``, ``ssn``, ``secret``, ``local_phone``, ``ipv6``) are reported when their score reaches ``threshold``: a
check that passes gives most of the score, context words within ``reach`` code points raise it, and words that speak against
it lower it. Secrets are what a known prefix begins, or a long run of mixed letters and digits whose entropy is that of a
random one; hexadecimal runs need a context word, as digests are public.

Offsets are code points, the end is exclusive. Each scan takes time in proportion to the text, whatever it holds: the
patterns use possessive repeats and start only where a run starts, and addresses are grown outwards from their ``@``.

Defined results: null and empty texts have no spans. Rows are handled one by one, so ties and repeated rows change nothing;
a null id is passed through. Only the id and text columns are read.
"""

from __future__ import annotations

import ipaddress
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from brindle.llm.common import map_rows, pick

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "amex", "ssn", "secret", "local_phone", "ipv6")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Public prefixes of access keys and tokens.
_PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?<![0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.][0-9]{4}(?![0-9-])")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{4,39}(?![0-9A-Fa-f:])")

#: Context words by kind; the first tuple speaks for the kind, the second against it.
CONTEXT = {
    "email": (("mail", "contact", "write to", "kontakt", "correo", "courriel"), ()),
    "ip": (("ip", "host", "server", "address", "adresse", "servidor"), ("version", "section", "release", "build")),
    "card": (("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "payment"), ("order", "serial", "tracking", "isbn")),
    "phone": (("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"), ("serial", "isbn")),
    "iban": (("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"), ("serial", "key")),
    "amex": (("card", "amex", "american express", "credit", "karte", "carte", "tarjeta"), ("order", "serial", "imei", "tracking")),
    "ssn": (("ssn", "social security", "taxpayer", "social", "security number"), ("part", "phone", "fax", "isbn", "serial")),
    "secret": (("token", "secret", "password", "passwd", "api", "key", "auth", "bearer", "credential"), ("sha1", "sha256", "md5", "commit", "checksum", "digest", "etag")),
    "local_phone": (("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"), ("serial", "isbn", "version", "part")),
    "ipv6": (("ip", "host", "server", "address", "adresse", "servidor"), ("time", "ratio", "mac")),
}
#: Score of a span whose check passed, before the context is looked at.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "amex": 0.6, "ssn": 0.3, "secret": 0.3, "local_phone": 0.3, "ipv6": 0.6}
#: Score of a secret with a known prefix.
KNOWN_PREFIX = 0.9
RAISE, LOWER = 0.3, 0.3


def luhn(digits: str) -> bool:
    """Whether the Luhn check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces leaves 1 modulo 97 after its first four characters moved to the end."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # matches do not reach back over the one before
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1) if at > free and text[at - 1] in _LOCAL else None
        if domain:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            yield start, domain.end()
            free = domain.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def entropy(s: str) -> float:
    """Bits for each character, by the string's own frequencies."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def looks_random(s: str) -> bool:
    """A long run that has letters, digits and about the entropy of a random one of its alphabet and length."""
    body = s.strip("-_/+")
    if len(body) < 20 or not any(c.isdigit() for c in body) or not any(c.isalpha() for c in body):
        return False
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:]))
    return switches * 6 >= len(body) and entropy(body) >= 0.75 * min(4.0 if re.fullmatch("[0-9a-fA-F]+", body) else 6.0, math.log2(len(body)))


def _is_ipv6(s: str) -> bool:
    try:
        return not ipaddress.IPv6Address(s).is_unspecified
    except ValueError:
        return False


def _only_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and then by start."""
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 8 <= len(_only_digits(m[0])) <= 15:
            yield "phone", *m.span()


def added_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the further kinds whose check passed."""
    for m in _IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            yield "iban", *m.span()
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) == 15 and digits[:2] in ("34", "37") and luhn(digits):
            yield "amex", *m.span()
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()
    known = [m.span() for m in _PREFIXED.finditer(text)]
    for start, end in sorted(known + [m.span() for m in _RUN.finditer(text) if looks_random(m[0]) and not any(s < m.end() and m.start() < e for s, e in known)]):
        yield "secret", start, end
    for m in _LOCAL_PHONE.finditer(text):
        yield "local_phone", *m.span()
    for m in _IPV6.finditer(text):
        if _is_ipv6(m[0]):
            yield "ipv6", *m.span()


def score(text: str, kind: str, start: int, end: int, reach: int = 48) -> float:
    """Prior of the kind, raised by a context word for it and lowered by one against it; 0 to 1."""
    near = f"{text[max(0, start - reach) : start]} {text[end : end + reach // 2]}".lower()
    words_for, words_against = CONTEXT[kind]
    found = lambda words: any(re.search(rf"(?<!\w){re.escape(w)}", near) for w in words)
    prior = KNOWN_PREFIX if kind == "secret" and _PREFIXED.fullmatch(text, start, end) else PRIOR[kind]
    return min(1.0, max(0.0, prior + RAISE * found(words_for) - LOWER * found(words_against)))


def find_spans(text: str | None, threshold: float = 0.5) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, is base) in the order of KINDS, then by start."""
    if not text:
        return []
    found = [(k, s, e, score(text, k, s, e), True) for k, s, e in base_spans(text)]
    for k, s, e in added_spans(text):
        if (value := score(text, k, s, e)) >= threshold:
            found.append((k, s, e, value, False))
    return found


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (kind, start, end, score, base). One pass, no shuffle."""
    table = pick(docs, id_col, text_col)
    kind = table.schema["c0"].dataType.simpleString()

    def rows(read):
        for key, text in read:
            yield key, [dict(zip(("kind", "start", "end", "score", "base"), s)) for s in find_spans(text, threshold)]

    return map_rows(table, f"id {kind}, spans array<struct<kind:string,start:long,end:long,score:double,base:boolean>>", rows).withColumnRenamed("id", id_col)


def redact(text: str | None, threshold: float = 0.5) -> str | None:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the one that starts first stays."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end, _, _ in sorted(find_spans(text, threshold), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join([*out, text[at:]])
