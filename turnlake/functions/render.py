"""Chat rendering, tokens with offsets, and records from messages.

The template and the tokens are deterministic and native: a message is
``<|im_start|>role\\ncontent<|im_end|>\\n``; tokens are markers, single blanks and line ends,
and runs of other characters. Other templates and tokenizers fit the same functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlake.functions import seq
from turnlake.functions import text as T
from turnlake.schemas import NO_LOSS, REGION_CONTEXT, REGION_FINAL, REGION_TAG, REGION_TOOL_CALL

START, END, HEADER = "<|im_start|>", "<|im_end|>", "<|im_start|>assistant\n"
TOKEN = r"(<\|im_(?:start|end)\|>|[ \n]|[^ \n<]+|<)"


def render(messages: Column) -> Column:
    """array<struct<role, content>> to text."""
    one = lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(END + "\n"))
    return F.array_join(F.transform(messages, one), "")


def render_prompt(messages: Column) -> Column:
    """The text up to where the assistant's next turn starts."""
    return F.concat(render(messages), F.lit(HEADER))


def assistant_spans(text: Column) -> Column:
    """Per assistant turn what follows the header, its end marker included; an unterminated turn has no span."""
    return F.transform(T.payload_spans(text, HEADER, END), lambda x: F.struct(x["s"].alias("s"), (x["e"] + len(END)).alias("e")))


def tag_spans(text: Column, tag: str) -> Column:
    """All places of a tag."""
    parts = F.transform(F.split(text, T._quoted(tag)), lambda x: F.length(x) + len(tag))
    ends = lambda v: F.transform(F.slice(seq.offsets(v), F.lit(1), F.size(v) - 1), lambda x: F.struct((x["e"] - len(tag)).alias("s"), x["e"].alias("e")))
    return seq.let(parts, ends)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def token_ids(toks: Column, vocab: int = 50_000) -> Column:
    """Stable ids of tokens, from 1."""
    return F.transform(toks, lambda t: (F.pmod(F.xxhash64(t), F.lit(vocab)) + 1).cast("int"))


def piece_lengths(pieces: Column, binary: bool = False) -> Column:
    """The code points that each piece adds to the text. A binary piece may end inside a character,
    which then counts where it begins, as decoding ever longer prefixes would count it."""
    if not binary:
        return F.transform(pieces, F.length)
    return F.transform(pieces, lambda p: F.length(F.regexp_replace(F.decode(p, "ISO-8859-1"), "[\\x{80}-\\x{BF}]", "")))


def aligned(df, pieces: str = "pieces", tokenize=tokens):
    """df with generated tokens' texts (strings, or bytes) plus text, offsets of the pieces in it, and
    roundtrip_exact: whether tokenising the text gives the same pieces again. Where it does not,
    the offsets are still those of the given pieces. No pieces: an empty text, exact. Bytes that
    are not UTF-8 become replacement characters in the text and are never exact."""
    binary = df.schema[pieces].dataType.elementType.typeName() == "binary"
    if binary:
        joined = F.encode(F.array_join(F.transform(pieces, lambda p: F.decode(p, "ISO-8859-1")), ""), "ISO-8859-1").cast("string")
        text, same = F.make_valid_utf8(joined), F.transform(pieces, lambda p: F.hex(p))
        again = lambda t: F.transform(tokenize(t), lambda x: F.hex(F.encode(x, "UTF-8")))
    else:
        text, same, again = F.array_join(pieces, ""), F.col(pieces), tokenize
    out = df.withColumns({"text": text, "offsets": seq.offsets(piece_lengths(F.col(pieces), binary))})
    return out.withColumn("roundtrip_exact", F.coalesce(again(F.col("text")) == same, F.lit(False)))


def with_offsets(df, text: str):
    """df plus tokens and offsets of column text; an assertion checks that tokens make up the text."""
    out = df.withColumn("tokens", tokens(F.col(text)))
    whole = F.array_join("tokens", "") == F.col(text)
    out = out.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("tokens do not make up the text")).cast("boolean")))
    return out.withColumn("offsets", seq.offsets(F.transform("tokens", F.length)))


def records(df, text: str = "text", call_open: str = "<tool_call>", call_close: str = "</tool_call>", answer: str | None = None):
    """Rendered texts to records: ids, labels on assistant spans, regions by precedence tag >
    call > final answer > prose, and context where there is no loss."""
    out = with_offsets(df, text)
    t = F.col(text)
    none = F.expr("cast(array() as array<struct<s: int, e: int>>)")
    at = T.last_span(t, F.col(answer)).cast("int") if answer else None
    final = F.when(at.isNotNull(), F.array(F.struct(at.alias("s"), (at + F.length(answer)).alias("e")))).otherwise(none) if answer else none
    out = out.withColumns({"_turns": assistant_spans(t), "_tags": F.concat(tag_spans(t, call_open), tag_spans(t, call_close)), "_calls": T.payload_spans(t, call_open, call_close), "_final": final})
    out = out.withColumn("input_ids", token_ids(F.col("tokens")))
    out = out.withColumn("labels", seq.loss_labels(F.col("input_ids"), F.col("offsets"), F.col("_turns")))
    regions = seq.regions_of(F.col("offsets"), [(F.col("_tags"), REGION_TAG), (F.col("_calls"), REGION_TOOL_CALL), (F.col("_final"), REGION_FINAL)])
    out = out.withColumn("_r", F.zip_with(regions, "labels", lambda r, l: F.when(l == NO_LOSS, F.lit(REGION_CONTEXT)).otherwise(r)))
    first = seq.let(F.col("labels"), lambda v: F.coalesce(F.get(F.filter(seq.indices(v), lambda i: F.get(v, i) != NO_LOSS), F.lit(0)), F.size(v)))
    out = out.withColumns({"regions": seq.rle(F.col("_r")), "n_prompt_tokens": first, "n_tokens": F.size("input_ids"), "n_tool_calls": F.size("_calls")})
    return out.drop("_turns", "_tags", "_calls", "_final", "_r", "tokens", "offsets")
