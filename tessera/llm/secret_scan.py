"""Secret scans with structural confirmation.

Base spans (fixed patterns) are found in every whole text. Then runs of base64 or hex digits are candidates, base64
also over lines and escaped line ends: they are reported only if they decode to a private key in DER, opened down to its
numbers, an OpenSSH private key whose length-prefixed fields fit, or a signed token whose header is JSON with an
algorithm. Public keys are none.

Spans are (kind, start, end) in code points, end exclusive, ordered by start, then kind as in ``KINDS``.

Defined cases: null text has no spans; null doc_id is scanned like any other; repeated rows are scanned each; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import slices

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are whole where they begin, so asking for the least length at once finds what filtering whole runs would.
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20

KINDS = ("assign", "access", "hex", "pem_key", "der_key", "ssh_key", "signed_token")
_ORDER = {kind: k for k, kind in enumerate(KINDS)}

PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nr])+)-----END \1-----")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: base64 of a DER sequence begins MA to MH if its length is in the short form, MI if in the long one, of an OpenSSH key
#: b3BlbnNzaC1rZXk. It may go on over line ends, real ones or escaped.
_BREAK = r"(?:\r?\n|\\r\\n|\\n)[\x20\t]*"
BASE64_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:M[A-I]|b3BlbnNzaC1rZXk)[A-Za-z0-9+/_-]{{38,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*={{0,2}}")
_BREAKS, _DIGITS64 = re.compile(_BREAK), re.compile(r"[A-Za-z0-9+/_-]+")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}")
_SSH = b"openssh-key-v1\0"


def _length(data: bytes, at: int) -> tuple[int, int]:
    """Length of a DER value and where it starts; (-1, at) if malformed."""
    if at >= len(data):
        return -1, at
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data) or data[at + 1] == 0:
        return -1, at
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n


def _children(data: bytes, lo: int, hi: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[lo:hi]; None unless they fill it exactly."""
    out = []
    while lo < hi:
        tag = data[lo]
        size, start = _length(data[:hi], lo + 1)
        if size < 0 or start + size > hi:
            return None
        out.append((tag, start, start + size))
        lo = start + size
    return out


def _is_number(data: bytes, part: tuple[int, int, int], values: tuple[int, ...]) -> bool:
    return part[0] == 0x02 and part[2] - part[1] == 1 and data[part[1]] in values


def _is_curve_key(data: bytes, parts: list[tuple[int, int, int]], nested: bool) -> bool:
    """Version 1, the secret number, and the curve or the public key (which may be left out within another key)."""
    if len(parts) < 2 or not _is_number(data, parts[0], (1,)) or parts[1][0] != 0x04 or not 20 <= parts[1][2] - parts[1][1] <= 66:
        return False
    more = parts[2:]
    return all(tag in (0xA0, 0xA1) and _children(data, lo, hi) for tag, lo, hi in more) and bool(more or nested)


def _is_number_key(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """Version 0 or 1 and at least five numbers, one of 16 bytes or more among them: RSA and DSA."""
    return len(parts) >= 6 and _is_number(data, parts[0], (0, 1)) and all(tag == 0x02 and lo < hi for tag, lo, hi in parts) and any(hi - lo >= 16 for _, lo, hi in parts)


def _is_algorithm(data: bytes, part: tuple[int, int, int]) -> bool:
    inner = _children(data, part[1], part[2]) if part[0] == 0x30 else None
    return bool(inner) and inner[0][0] == 0x06 and inner[0][1] < inner[0][2]


def _is_wrapped_key(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """Version, algorithm, and an octet string that holds one whole value: a key of numbers, of a curve, a number or a string."""
    if len(parts) < 3 or not _is_number(data, parts[0], (0, 1)) or not _is_algorithm(data, parts[1]) or parts[2][0] != 0x04:
        return False
    inner = _children(data, parts[2][1], parts[2][2])
    if not inner or len(inner) != 1:
        return False
    tag, lo, hi = inner[0]
    if tag == 0x30:
        held = _children(data, lo, hi)
        return bool(held) and (_is_number_key(data, held) or _is_curve_key(data, held, True))
    return tag in (0x02, 0x04) and hi - lo >= 16


def _is_encrypted_key(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    return len(parts) == 2 and _is_algorithm(data, parts[0]) and parts[1][0] == 0x04 and parts[1][2] - parts[1][1] >= 16


def der_end(data: bytes) -> int:
    """Bytes of a private key at the start of ``data``: a sequence of whole values that is a key of numbers (RSA, DSA),
    of a curve, one wrapped with its algorithm, or an encrypted one. 0 if there is none, as for public keys."""
    if len(data) < 18 or data[0] != 0x30:
        return 0
    size, start = _length(data, 1)
    if size < 16 or start + size > len(data):
        return 0
    parts = _children(data, start, start + size)
    if not parts:
        return 0
    known = _is_number_key(data, parts) or _is_curve_key(data, parts, False) or _is_wrapped_key(data, parts) or _is_encrypted_key(data, parts)
    return start + size if known else 0


def ssh_end(data: bytes) -> int:
    """Bytes of an OpenSSH private key: after the magic three length-prefixed strings, a count of keys, then
    length-prefixed strings. 0 if there is none."""
    if not data.startswith(_SSH):
        return 0
    at = len(_SSH)
    for k in range(5):
        if k == 3:
            if int.from_bytes(data[at : at + 4], "big") not in range(1, 17):
                return 0
            at += 4
        if at + 4 > len(data):
            return 0
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return 0
    return at


def decode64(run: str) -> bytes:
    """Bytes of a base64 run in either alphabet, as far as whole quanta go; empty if it is none."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        run = run[:-1]
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_signed_header(part: str) -> bool:
    try:
        head = json.loads(decode64(part))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and (str(head.get("typ", "JWT")).upper() in ("JWT", "JWS", "AT+JWT") or "kid" in head)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _digits_end(run: str, n: int) -> int:
    """Where the first ``n`` digits of a run of lines end, with the padding after them."""
    at = 0
    while n:
        gap = _BREAKS.match(run, at)
        at = gap.end() if gap else at
        line = _DIGITS64.match(run, at)
        at, n = line.start() + min(n, line.end() - line.start()), max(0, n - (line.end() - line.start()))
    return at + len(run[at:]) - len(run[at:].lstrip("="))


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates that decode to what they look like."""
    spans = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            body = decode64("".join(re.sub(r"\\[nr]", "", m[2]).split()))
            if ssh_end(body) or der_end(body):
                spans.append(("pem_key", m.start(), m.end()))
    if "eyJ" in text:
        spans += [("signed_token", m.start(), m.end()) for m in SIGNED.finditer(text) if is_signed_header(m[1])]
    for m in BASE64_RUN.finditer(text):
        body = decode64(_BREAKS.sub("", m[0]))
        size, kind = (ssh_end(body), "ssh_key") if body.startswith(_SSH) else (der_end(body), "der_key")
        if size:
            spans.append((kind, m.start(), m.start() + _digits_end(m[0], -(-4 * size // 3))))
    for m in HEX_RUN.finditer(text):
        size = der_end(bytes.fromhex(m[0][: len(m[0]) // 2 * 2]))
        if size:
            spans.append(("der_key", m.start(), m.start() + 2 * size))
    return spans


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def digest_form(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, at, covered = [], 0, 0
    for _, lo, hi in ordered(spans):
        if lo >= covered:
            out += [text[at:lo], mark]
        covered = at = max(covered, hi)
    return "".join(out) + text[at:]


_FOUND = pa.schema(
    [("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in ("assign", "access", "hex")] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_confirmed", pa.int64())]
)


def _scan(batches):
    for batch in slices(batches):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base = ordered(base_spans(text or ""))
            more = confirmed_spans(text or "")
            kinds = [kind for kind, _, _ in base]
            rows.append((doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(digest_form(base).encode()).hexdigest(), digest_form(ordered(base + more)), len(more)))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_FOUND), _FOUND, strict=True)], schema=_FOUND)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of base spans, their digest, all spans, and how many the method confirmed."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by a mark; other columns as they are."""
    at = docs.columns.index("text")

    def run(batches):
        for part in slices(batches):
            field = part.schema.field(at)
            texts = [None if t is None else redact(t, base_spans(t) + confirmed_spans(t)) for t in part.column(at).to_pylist()]
            yield part.set_column(at, field, pa.array(texts, field.type))

    return docs.mapInArrow(run, docs.schema)
