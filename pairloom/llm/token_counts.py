"""Token counts with a public tokenizer, lengths only.

A text is cut where no token can reach across, so its count is the sum of its pieces' counts.  Where that is safe follows from the tokenizer's own
definition (``boundaries``): at white space if the pre-tokenizer drops it, before white space if it leads the next piece, nowhere if neither is
certain.  Pieces of more than ``LONG_BYTES`` are cut further between ASCII letters and digits and behind full-width punctuation, where these
pre-tokenizers always cut.  Pieces are encoded by the tokenizer library itself, each distinct one once per worker (a bounded table).  New pieces of
many texts are encoded together in batches of about ``BATCH_BYTES``, so a batch of long texts costs no more memory than one of short texts.

Defined results: null and empty text: 0 bytes, 0 tokens; white space only: its bytes, and the tokens that the library gives; exactly ``limit`` tokens
aren't over it; repeated rows: a row each; an empty table gives an empty table; a very long text is held once with its pieces, and one without any
safe boundary is encoded whole.  Only ``text_col`` is read; a column of the result's name leads to another name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import unused_name

#: Bytes of new pieces that are encoded together, and of texts that are looked at together.
BATCH_BYTES, GROUP_BYTES = 2_000_000, 8_000_000
#: Longer pieces are encoded each time and not kept; the table is emptied when it has so many entries; pieces longer still are cut further.
PIECE_BYTES, TABLE_ROWS, LONG_BYTES = 96, 1_500_000, 50_000

#: Patterns of pre-tokenizers that cut between letters, digits and the rest, and never join white space to what is before it.
_DROPPING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LEADING = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[\t-\r ])")
_BEFORE_BLANK = re.compile(r"(?<=[^ ▁]) (?=[^\s▁])")
_INSIDE = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[、。，．！？；：])(?=[^\W\d_])")

Pieces = Callable[[str], list[str]]


def _dropping(text: str) -> list[str]:
    """Words between ASCII white space; bytes have no other, while str.split knows more."""
    return [w.decode() for w in text.encode().split()]


def _leading(text: str) -> list[str]:
    return _BEFORE_SPACE.split(text) if text else []


def _blank_led(text: str) -> list[str]:
    """For models that put one blank before every text: the blank at a cut is the one that will be put there."""
    return _BEFORE_BLANK.split(text) if text else []


def _whole(text: str) -> list[str]:
    return [text] if text else []


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if raw[at - 1] < 128:
            return value, at


def _fields(raw: bytes) -> Iterable[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(key & 7) or _varint(raw, at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def boundaries(path: str) -> tuple[Pieces, bool]:
    """How texts for this tokenizer may be cut, and whether long pieces may be cut further."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            raw = f.read()
        spec, joined = {}, False
        for number, value in _fields(raw):
            if number == 1:  # a piece: a blank may only lead it
                name = dict(_fields(value)).get(1, b"").decode()
                joined = joined or "▁" in name.lstrip("▁")
            elif number == 3:  # how texts are normalised
                spec = dict(_fields(value))
        plain = spec.get(1) == b"identity" and not spec.get(2) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1
        return (_blank_led if plain and not joined else _whole), False
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s|\d", t["content"]) for t in own.get("added_tokens") or []):
        return _whole, False
    pre = own.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    steps = own.get("normalizer") or {}
    steps = steps.get("normalizers") or ([steps] if steps else [])
    blank = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    narrow = all(s["type"] in ("NFC", "Lowercase") or s == blank for s in steps)  # nothing is joined across white space
    if narrow and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and first["pattern"].get("Regex") == _DROPPING:
        return _dropping, True
    if not steps and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space"):
        return _leading, True
    return _whole, False


_encoders: dict[str, tuple[Callable[[list[str]], list[int]], Pieces, bool]] = {}
_known: dict[str, dict[str, int]] = {}


def encoder(path: str) -> tuple[Callable[[list[str]], list[int]], Pieces, bool]:
    """Texts to lengths by the library the file is for, and where they may be cut; loaded once per worker."""
    if path not in _encoders:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            encode = lambda texts: [len(e) for e in own.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        _encoders[path] = (encode, *boundaries(path))
    return _encoders[path]


def by_bytes(pieces: Iterable[str], size: int = BATCH_BYTES) -> Iterable[list[str]]:
    """Batches of pieces whose bytes add up to about ``size``."""
    batch, total = [], 0
    for p in pieces:
        batch.append(p)
        total += len(p.encode()) + 32
        if total >= size:
            yield batch
            batch, total = [], 0
    if batch:
        yield batch


def _pieces(text: str, cut: Pieces, further: bool) -> list[str]:
    pieces = cut(text)
    if further and len(text) > LONG_BYTES and any(len(p) > LONG_BYTES for p in pieces):
        pieces = [x for p in pieces for x in (_INSIDE.split(p) if len(p) > LONG_BYTES else (p,))]
    return pieces


def _group(texts: list[str], path: str) -> list[int]:
    """Tokens of texts that are looked at together: what is new in any of them is encoded in common batches."""
    encode, cut, further = encoder(path)
    known = _known.setdefault(path, {})
    out, waiting = [0] * len(texts), []
    for k, text in enumerate(texts):
        pieces = _pieces(text, cut, further)
        try:
            out[k] = sum(map(known.__getitem__, pieces))
        except KeyError:
            waiting.append((k, pieces))
    if not waiting:
        return out
    if len(known) > TABLE_ROWS:
        known.clear()
    rest: dict[str, int] = {}
    for batch in by_bytes({p for _, pieces in waiting for p in pieces if p not in known}):
        for p, n in zip(batch, encode(batch), strict=True):
            (known if len(p) <= PIECE_BYTES else rest)[p] = n
    for k, pieces in waiting:
        out[k] = sum(known[p] if p in known else rest[p] for p in pieces)
    return out


def count_tokens(texts: list[str | None], path: str) -> tuple[list[int], list[int]]:
    """UTF-8 bytes and tokens of each text."""
    n_bytes, n_tokens = [], []
    group, size = [], 0
    for text in texts:
        n_bytes.append(len(text.encode()) if text else 0)
        group.append(text or "")
        size += n_bytes[-1]
        if size >= GROUP_BYTES:
            n_tokens += _group(group, path)
            group, size = [], 0
    return n_bytes, n_tokens + _group(group, path)


def with_token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048, out: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct (n_bytes, n_tokens, over_limit); a narrow operation.  Returns the frame and the struct's name."""
    out = out or unused_name(docs, "token_counts")

    @F.arrow_udf("struct<n_bytes:bigint,n_tokens:bigint,over_limit:boolean>")
    def counted(text: pa.Array) -> pa.Array:
        os_setting()
        b, n = count_tokens(text.to_pylist(), path)
        return pa.StructArray.from_arrays([pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["n_bytes", "n_tokens", "over_limit"])

    return docs.withColumn(out, counted.asNondeterministic()(F.col(text_col))), out


def os_setting() -> None:
    """A worker uses its own core only."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
