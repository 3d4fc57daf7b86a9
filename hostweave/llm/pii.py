"""Personal data: patterns propose spans, check digits confirm them, context weighs them.

Base kinds (email, ip, card, phone) are fixed patterns with fixed checks and are
always kept. The method adds kinds whose patterns alone say little: bank account
numbers (IBAN, mod 97), IPv6 addresses (read as the system reads them), access keys, assigned secrets, and digit groups that only
words nearby make a phone number, a social security number or a card number. Each
such span gets a score, from its pattern, its check and the words around it, and
stays if the score reaches ``MIN_SCORE``.
"""

import bisect
import hashlib
import ipaddress
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from hostweave.llm.common import give_back, text_chunks

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone", "secret", "ipv6")
MIN_SCORE = 0.6
#: Characters before and after a span whose words count as its context.
CONTEXT = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
# Characters of a bank account number by country.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20}
_LOWER_IBAN = re.compile(r"(?<![A-Za-z0-9])[a-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
_IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![\w:])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])\(?[0-9]{2,5}\)?[ ./-][0-9]{2,8}(?:[ ./-][0-9]{2,5}){0,3}(?![0-9])")
_YEARS = re.compile(r"(?:19|20)[0-9]{2}(?:[-/](?:19|20)[0-9]{2})+")
_ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])")
_BEARER = re.compile(r"(?i)(?<![a-z0-9])bearer\s++([A-Za-z0-9._~+/-]{16,}+=*)")
_ASSIGNED = re.compile(
    r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|pwd|api[_-]?key)\s*+[=:]\s*+\"?([^\s\"]{8,})\"?")

# Words that speak for a kind, in lower case.
_SPEAKS = {
    "iban": re.compile(r"\b(?:iban|bank|account|konto|cuenta|compte|bic|swift)\b"),
    "ssn": re.compile(r"\b(?:ssn|social|security|tax|id)\b"),
    "local_phone": re.compile(r"\b(?:phone|tel|telefon|telephone|teléfono|téléphone|call|mobile|fax|cell|handy)\b"),
    "ipv6": re.compile(r"\b(?:ip|ipv6|address|host|server|client|adresse|dirección)\b"),
    "secret": re.compile(r"\b(?:key|token|secret|password|passwd|api|access|aws)\b"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of an international bank account number."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def lower_accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers that begin in lower case.

    Words look like their pattern, so the country must be known, its length met at
    the end of a group, half of the characters after the country digits, and the check right.
    """
    for m in _LOWER_IBAN.finditer(text):
        size = IBAN_SIZES.get(m.group()[:2].upper())
        at = [i for i in range(m.start(), m.end()) if text[i] != " "]
        if size is None or len(at) < size:
            continue
        code, end = "".join(text[i] for i in at[:size]), at[size - 1] + 1
        whole = end == len(text) or not (text[end].isascii() and text[end].isalnum())
        if whole and 2 * sum(c.isdigit() for c in code) >= size - 2 and mod97(code):
            yield m.start(), end


def hex_addresses(text: str) -> Iterator[tuple[int, int]]:
    """IPv6 addresses of three groups or more with a digit, so that ``a::b`` in program text is none."""
    for m in _IPV6.finditer(text):
        own = m.group()
        if sum(map(bool, own.split(":"))) < 3 or not _DIGIT.search(own):
            continue
        try:
            ipaddress.IPv6Address(own)
        except ValueError:
            continue
        yield m.start(), m.end()


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[local]+@[label]+(.label)+``, found from each @ in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Groups of four dotted numbers up to 255; a longer chain is cut into fours."""
    for chain in _DOTTED.finditer(text):
        own = chain.group()
        if own.count(".") < 3:
            continue
        parts, at = own.split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each base kind that pass their check, by kind and start."""
    spans = []
    if "@" in text:
        spans += [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            spans += [("ip", a, b) for a, b in addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    spans.append(("phone", m.start(), m.end()))
    return spans


def _score(kind: str, text: str, start: int, end: int, own: float) -> float:
    near = (text[max(0, start - CONTEXT):start] + " " + text[end:end + CONTEXT]).lower()
    return min(1.0, own + 0.4 * bool(_SPEAKS[kind].search(near)))


def added_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """Further spans with their scores, none of which overlaps a base span or another."""
    proposed = []
    if _DIGIT.search(text):
        for m in _IBAN.finditer(text):
            # a following group that is not part of the number must not spoil its check
            groups = m.group().split(" ")
            for n in range(len(groups), 0, -1):
                code = "".join(groups[:n])
                if 15 <= len(code) <= 34 and mod97(code):
                    end = m.start() + len(" ".join(groups[:n]))
                    proposed.append(("iban", m.start(), end, 0.9))
                    break
        proposed += [("iban", a, b, 0.9) for a, b in lower_accounts(text)]
        if ":" in text:
            proposed += [("ipv6", a, b, 0.7) for a, b in hex_addresses(text)]
        proposed += [("ssn", m.start(), m.end(), 0.4) for m in _SSN.finditer(text)]
        proposed += [("local_phone", m.start(), m.end(), 0.3) for m in _LOCAL_PHONE.finditer(text)
                     if 7 <= sum(c.isdigit() for c in m.group()) <= 12 and not _YEARS.fullmatch(m.group())]
        proposed += [("secret", m.start(), m.end(), 0.9) for m in _ACCESS_KEY.finditer(text)]
    for shape in [_ASSIGNED] * ("=" in text or ":" in text) + [_BEARER]:
        for m in shape.finditer(text):
            value = m.group(1)
            mixed = any(c.isdigit() for c in value) + any(c.isalpha() for c in value)
            proposed.append(("secret", m.start(1), m.end(1), 0.4 + 0.2 * (mixed == 2)))
    kept, used = [], _merged((a, b) for _, a, b in taken)
    for kind, start, end, own in sorted(proposed, key=lambda s: (ADDED.index(s[0]), s[1])):
        score = _score(kind, text, start, end, own)
        if score < MIN_SCORE:
            continue
        at = bisect.bisect_left(used, (end,))  # the last span that starts before the end
        if at == 0 or used[at - 1][1] <= start:
            kept.append((kind, start, end, score))
            used.insert(at, (start, end))
        elif kind in ("iban", "secret"):  # what other spans leave of it is still part of it
            for a, b in _between(used, start, end):
                if any(c.isalnum() for c in text[a:b]):
                    kept.append((kind, a, b, score))
                    bisect.insort(used, (a, b))
    return kept


def _between(used: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a span that no span of ``used`` covers."""
    first = max(0, bisect.bisect_left(used, (start,)) - 1)
    found = []
    for a, b in used[first:bisect.bisect_left(used, (end,))]:
        if start < a:
            found.append((start, a))
        start = max(start, b)
    return [*found, (start, end)] if start < end else found


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans joined, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def written(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def found_spans(docs: DataFrame) -> DataFrame:
    """Per document its personal data: counts, spans and a digest of the base spans.

    Columns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256,
    spans (all, as kind:start:end in code points, end exclusive, by kind, then
    start), n_added and min_score (the lowest score of an added span, null
    without one). A null or empty text has none; repeated rows and null ids give
    rows of their own; other columns are ignored. All patterns are linear in the
    length of a text but for context words, which look at a fixed number of
    characters around a span.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), texts in text_chunks(batches, ["doc_id"], "text", 1 << 22):
            rows = []
            for data in texts:
                text = data.decode()
                base = base_spans(text)
                added = added_spans(text, base)
                kinds = [s[0] for s in base]
                rows.append((
                    *(kinds.count(k) for k in BASE),
                    hashlib.sha256(written(base).encode()).hexdigest(),
                    written(base + added), len(added), min((s[3] for s in added), default=None)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4]),
                 pa.array(columns[5]), pa.array(columns[6], pa.int64()), pa.array(columns[7], pa.float64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans",
                       "n_added", "min_score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_email bigint, n_ip bigint, n_card bigint,"
        " n_phone bigint, base_sha256 string, spans string, n_added bigint, min_score double")


def redacted(text: str) -> str:
    """The text with a mark like [EMAIL] in place of each span."""
    base = base_spans(text)
    out, at = [], 0
    for kind, start, end, *_ in sorted([*base, *added_spans(text, base)], key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue  # inside the last span
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end  # of two spans that overlap, the rest of the second goes too
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data marked in ``text``; null stays null, rows and columns stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what earlier stages of a pipeline held in this worker
        for batch in batches:
            texts = [t if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        give_back()

    return docs.mapInArrow(run, docs.schema)
