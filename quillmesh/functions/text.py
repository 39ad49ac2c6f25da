"""Text preparation as built-in expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.binding import bind, bind_all

# Token pattern, reserved ids, separators.
WORD_PATTERN = r"[\p{L}\p{N}]+"
TAG_PATTERN = r"<[^>]+>"
TURN_SEPARATOR = "[SEP]"
CLS_ID = 0
PAD_ID = 1
EOS_ID = 2
UNK_ID = 3
SPECIAL_IDS = (CLS_ID, PAD_ID, EOS_ID, UNK_ID)

# Unicode white space plus the four ASCII separators that Python's str.strip() also removes.
_STRIP_PATTERN = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, with the character set of Python's ``str.strip``."""
    return F.regexp_replace(text, _STRIP_PATTERN, "")


def clean_html(html: Column) -> Column:
    """Delete tags and line feeds (both replaced by nothing), then strip.

    Script and style bodies stay, entities are not decoded.
    """
    no_tags = F.regexp_replace(html, TAG_PATTERN, "")
    return strip(F.replace(no_tags, F.lit("\n"), F.lit("")))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def token_id(token: Column) -> Column:
    """60-bit id of a token: the first 15 hex digits of its MD5."""
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("bigint")


def token_ids(text: Column) -> Column:
    """Token ids of a text in order, without special tokens and without truncation."""
    return F.transform(tokens(text), token_id)


def _ids(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _attended(input_ids: Column, pad_to: int | None) -> Column:
    return bind(input_ids, lambda ids: _padded(ids, pad_to))


def _padded(input_ids: Column, pad_to: int | None) -> Column:
    n = F.size(input_ids)
    ones = F.array_repeat(F.lit(1), n)
    if pad_to is None:
        return F.struct(input_ids.alias("input_ids"), ones.alias("attention_mask"))
    gap = F.greatest(F.lit(0), F.lit(pad_to) - n)
    return F.struct(
        F.concat(input_ids, F.array_repeat(F.lit(PAD_ID).cast("bigint"), gap)).alias("input_ids"),
        F.concat(ones, F.array_repeat(F.lit(0), gap)).alias("attention_mask"),
    )


def encode(
    ids: Column, max_length: int = 512, padding: str = "max_length", truncation: bool = True
) -> Column:
    """Token batch row ``struct<input_ids, attention_mask>`` of one text.

    ``padding='longest'`` leaves the row unpadded: how far a batch is padded is the runner's
    business and must not change results.
    """
    if padding not in ("max_length", "longest"):
        raise ValueError(f"unknown padding: {padding}")
    body = F.slice(ids, 1, max_length - 2) if truncation else ids
    return _attended(
        F.concat(_ids(CLS_ID), body, _ids(EOS_ID)), max_length if padding == "max_length" else None
    )


def pack_pair(
    query_ids: Column,
    text_ids: Column,
    max_length: int | None = 512,
    query_max_length: int | None = None,
) -> Column:
    """One padded sequence ``cls q eos eos d eos`` of a (query, text) pair.

    Only the text is shortened. A query that leaves it no room yields NULL ids and an ``error``. Without a
    ``max_length`` nothing is cut or padded.
    """
    q = F.slice(query_ids, 1, query_max_length) if query_max_length else query_ids
    if max_length is None:
        whole = _attended(F.concat(_ids(CLS_ID), q, _ids(EOS_ID, EOS_ID), text_ids, _ids(EOS_ID)), None)
        return bind(whole, lambda r: F.struct(r["input_ids"], r["attention_mask"], F.lit(None).cast("string").alias("error")))
    return bind_all([q, F.slice(text_ids, 1, max_length)], lambda q, d: _packed(q, d, max_length))


def _packed(q: Column, d: Column, max_length: int) -> Column:
    room = F.lit(max_length - 4) - F.size(q)
    fits = (F.size(d) <= room) | (room >= 1)
    kept = F.slice(d, F.lit(1), F.greatest(F.lit(0), room))
    row = _attended(F.concat(_ids(CLS_ID), q, _ids(EOS_ID, EOS_ID), kept, _ids(EOS_ID)), max_length)
    return bind(
        row,
        lambda r: F.struct(
            F.when(fits, r["input_ids"]).alias("input_ids"),
            F.when(fits, r["attention_mask"]).alias("attention_mask"),
            F.when(~fits, F.lit("query leaves no room for the text")).alias("error"),
        ),
    )


def join_history(turns: Column) -> Column:
    """Dialogue turns as one string, latest turn last."""
    return F.concat_ws(TURN_SEPARATOR, turns)
