"""Secret scans: fixed formats, and a token-efficiency test for random strings.

Base kinds are patterns over the whole text. The method adds kind ``random``: a long run of key characters, or a stretch
of it, with letters and digits or 20 letters in a row, that a byte-pair vocabulary needs many tokens for (few characters a
token) is a random string; known digests (hex of a digest's length), UUIDs and identifiers made of words are left out, and
what a base span covers is not given again. Byte-level NumPy tests over whole Arrow batches find
the texts that can match at all; only these are decoded and searched. Nothing is shuffled.

Defined cases: null text is empty and has no spans; very long texts are searched whole, very long runs in pieces; ties can't occur, as spans of a kind don't overlap; repeated rows each
get a row; an empty table gives an empty result; other columns are kept only by ``keep``, but for those named ``_text``,
``spans`` or ``redacted``, which the result's own replace.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, utf8, with_fields

KINDS = ("assign", "access", "hex", "random")
_ANY = "".join
_ASSIGN = re.compile(
    "(?:%s)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    % "|".join(_ANY(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_RUN = re.compile("[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile("[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile("(?:[0-9a-f]+|[0-9A-F]+)")
_KNOWN = re.compile(f"(?<![A-Za-z0-9])(?:{_UUID.pattern}|[0-9a-f]{{32,}}|[0-9A-F]{{32,}})(?![A-Za-z0-9])")
_PART = re.compile("[A-Za-z0-9+]+|[=/_-]+")
_LETTERS = re.compile("[A-Za-z]{20,}")
_DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
_WORDS = re.compile("[_/+=-]*(?:[A-Za-z]?[a-z]{3,}[0-9]{0,4}|[A-Z]{3,}[0-9]{0,4}|[0-9]{1,8})(?:[_/+=-]+(?:[A-Za-z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,8}))*[_/+=-]*")

LONG_RUN = 4096
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_IS_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_IS_KEY = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"))


def _finds(data: bytes, what: bytes) -> list[int]:
    out, at = [], data.find(what)
    while at >= 0:
        out.append(at)
        at = data.find(what, at + 1)
    return out


def _runs(mask: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows of so many set flags, by doubling."""
    have, m = 1, mask
    while have < length:
        step = min(have, length - have)
        m = m[:-step] & m[step:] if len(m) > step else m[:0]
        have += step
    return np.flatnonzero(m)


def encoding_of(rank_file: bytes, special: dict[str, int] | None = None, pattern: str | None = None):
    """A tiktoken encoding from a rank file's bytes."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special or {})


def load_encoding(vocabulary: str):
    with open(vocabulary, "rb") as f:
        return encoding_of(f.read())


def is_random(s: str, encoding, chars_per_token: float) -> bool:
    """Letters with digits, or many letters in a row (8 kinds at least); not a digest, UUID or identifier of words, and few characters a token."""
    letters = any(len(set(m[0].lower())) >= 8 for m in _LETTERS.finditer(s))
    if not (any(c.isalpha() for c in s) and (letters or any(c.isdigit() for c in s))):
        return False
    if _DIGEST.fullmatch(s) and len(s) in _DIGEST_LENGTHS or _UUID.fullmatch(s) or not letters and _WORDS.fullmatch(s):
        return False
    return len(s) / len(encoding.encode_ordinary(s)) < chars_per_token


def random_parts(s: str, encoding, chars_per_token: float) -> list[tuple[int, int]]:
    """Stretches of a run that are random strings: the run, or what is left of it without UUIDs and digests, or in these the
    tokens that are shortest together, out to the next separators where the stretch stays random; then both sides of it."""
    out, todo = [], [(0, len(s))]
    while todo:
        a, b = todo.pop()
        if b - a < 20:
            continue
        known = next((m for m in _KNOWN.finditer(s, a, b) if "-" in m[0] or len(m[0]) in _DIGEST_LENGTHS), None)
        rest = s[a : known.start()] + s[known.end() : b] if known else ""
        if known and len(rest) < 20 and not any(c.isdigit() for c in rest):  # a name and its UUID or digest
            continue
        if is_random(s[a:b], encoding, chars_per_token):
            out.append((a, b))
            continue
        if known:
            todo += [(a, known.start()), (known.end(), b)]
            continue
        best, total, begin, span, at = 0.0, 0.0, a, None, a
        for m in _PART.finditer(s, a, b):
            at = m.start()
            if not m[0][0].isalnum():  # separators count for neither side
                continue
            for t in encoding.encode_ordinary(m[0]):
                if total <= 0:
                    total, begin = 0.0, at
                k = len(encoding.decode_single_token_bytes(t))
                total, at = total + chars_per_token - k, at + k
                if total > best:
                    best, span = total, (begin, at)
        if span is None:
            continue
        i, j = span
        x, y = i, j
        while x > a and s[x - 1] not in "=/_-":
            x -= 1
        while y < b and s[y] not in "=/_-":
            y += 1
        wide = [(p, q) for p, q in ((x, y), (i, y), (x, j), (i, j)) if q - p >= 20 and (p, q) != (a, b) and is_random(s[p:q], encoding, chars_per_token)]
        if wide:
            i, j = wide[0]
            out.append((i, j))
        todo += [(a, i), (j, b)]
    return sorted(out)


def _stretches(run: str, encoding, chars_per_token: float) -> list[tuple[int, int]]:
    """Random stretches of a run; a run of over ``LONG_RUN`` characters is tested in pieces, cut at a separator if there is one
    in a piece's second half, and stretches that meet at a cut are one."""
    out, at = [], 0
    while at < len(run):
        end = min(len(run), at + LONG_RUN)
        if end < len(run):
            end = max([at + LONG_RUN // 2, *(run.rfind(c, at, end) + 1 for c in "=/_-")]) if any(run.rfind(c, at + LONG_RUN // 2, end) >= 0 for c in "=/_-") else end
        for i, j in random_parts(run[at:end], encoding, chars_per_token):
            if out and out[-1][1] == at + i:
                out[-1] = out[-1][0], at + j
            else:
                out.append((at + i, at + j))
        at = end
    return out


def find_spans(text: str, encoding, chars_per_token: float) -> list[tuple[int, str, int]]:
    """(start, kind, end) of one text, by start and kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base = sorted(out)
    k = 0
    for m in _RUN.finditer(text):
        while k < len(base) and base[k][2] <= m.start():
            k += 1
        for i, j in _stretches(m[0], encoding, chars_per_token):
            at, end, q = m.start() + i, m.start() + j, k
            while q < len(base) and base[q][0] < end:  # by start; what is left between them
                x, _, y = base[q]
                if at < x:
                    out.append((at, 3, x))
                at, q = max(at, y), q + 1
            if at < end:
                out.append((at, 3, end))
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each maximal covered stretch replaced by one mark."""
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a > at or not out:
            out += [text[at:a], "[SECRET]"]
        at = b
    return "".join(out) + text[at:]


def secret_spans(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, chars_per_token: float = 2.0) -> DataFrame:
    """Add ``spans`` (array of kind, start, end in code points, end exclusive) and ``redacted`` (null where nothing is found)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("spans", "redacted", "_text")]
    d = docs.select(*keep, F.col(text).alias("_text"))
    schema = with_fields(d, "spans array<struct<kind:string,start:long,end:long>>, redacted string", "_text")
    with open(vocabulary, "rb") as f:  # on the driver; tasks get the bytes
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(shared.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            raw, off = utf8(b.column("_text"))
            rows = set()
            for at in _candidates(raw, off):
                rows.update(np.unique(np.searchsorted(off, at, side="right") - 1).tolist())
            spans, clean = [[] for _ in range(b.num_rows)], [None] * b.num_rows
            for r in rows:
                x = raw[off[r] : off[r + 1]].tobytes().decode()
                found = find_spans(x, encoding, chars_per_token)
                if found:
                    spans[r] = [{"kind": k, "start": s, "end": e} for s, k, e in found]
                    clean[r] = redact(x, found)
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["_text"]).columns, pa.array(spans, kind), pa.array(clean, pa.string())], names=[*keep, "spans", "redacted"])

    return lean(d, run, schema)


def _candidates(raw: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Byte positions in all texts that can be in a span; of a run of key characters in a text, its start."""
    data = raw.tobytes()
    low = data.translate(_LOWER)
    for name in _NAMES:
        yield np.array(_finds(low, name), np.int64)
    yield np.array(_finds(data, b"AKIA"), np.int64)
    yield _runs(_IS_HEX[raw], 24)
    at = _runs(_IS_KEY[raw], 20)
    row = np.searchsorted(off, at, side="right") - 1
    inside = at + 20 <= off[row + 1]
    at, row = at[inside], row[inside]
    if len(at):
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(row) > 0))  # runs end where their row ends
        yield at[np.concatenate([[0], cut + 1])]


def span_text(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
