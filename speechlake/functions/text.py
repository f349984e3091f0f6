"""Hot words, prompts, raw recognition output, and deltas between successive texts.  Lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechlake.functions.arrays import bound

#: Marks of the prompt and of the raw output.
TEXT_MARK, LANGUAGE_MARK, AUDIO_PAD = "<asr_text>", "language ", "<|audio_pad|>"
AUDIO_START, AUDIO_END, TURN_START, TURN_END = "<|audio_start|>", "<|audio_end|>", "<|im_start|>", "<|im_end|>"


def _trim(s: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def normalize_hotwords(words: Column, is_array: bool = False) -> Column:
    """Comma-separated words (full-width commas too) as trimmed array, blanks dropped, order and repeats kept."""
    parts = words if is_array else F.split(F.translate(words, "，", ","), ",")
    return F.coalesce(F.filter(F.transform(parts, _trim), lambda w: w != ""), F.array().cast("array<string>"))


def context_with_hotwords(context: Column, words: Column, hint: str = "Hot words: ") -> Column:
    """The context unchanged without words; else trimmed, a line break, and the hint with the words joined by U+3001."""
    said = F.concat(F.lit(hint), F.array_join(words, "、"))
    bare = _trim(F.coalesce(context, F.lit("")))
    return F.when(F.size(words) == 0, F.coalesce(context, F.lit(""))).when(bare == "", said).otherwise(F.concat(bare, F.lit("\n"), said))


def build_prompt(context: Column, pads: Column, language: Column | None = None, prefix: Column | None = None) -> Column:
    """System turn, user turn with ``pads`` audio places, and the opened assistant turn."""
    forced = F.lit("") if language is None else F.when(F.coalesce(language, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(LANGUAGE_MARK), language, F.lit(TEXT_MARK)))
    turn = lambda role: F.lit(f"{TURN_START}{role}\n")
    end = F.lit(f"{TURN_END}\n")
    audio = F.concat(F.lit(AUDIO_START), F.repeat(F.lit(AUDIO_PAD), pads.cast("int")), F.lit(AUDIO_END))
    return F.concat(turn("system"), F.coalesce(context, F.lit("")), end, turn("user"), audio, end, turn("assistant"), forced, F.lit("") if prefix is None else F.coalesce(prefix, F.lit("")))


def parse_asr_output(raw: Column, forced: Column | None = None) -> Column:
    """struct(language, text): the text after the first text mark, the language before it; all is text without a mark."""
    raw = F.coalesce(raw, F.lit(""))
    at = F.instr(raw, TEXT_MARK)
    head = F.substring(raw, F.lit(1), at - 1)
    lang_at = F.instr(head, LANGUAGE_MARK)
    named = F.when(lang_at > 0, _trim(F.substring(head, lang_at + len(LANGUAGE_MARK), F.length(head))))
    language = F.when(at > 0, named)
    if forced is not None:
        language = F.coalesce(F.when(forced != "", forced), language)
    text = F.when(at > 0, F.substring(raw, at + len(TEXT_MARK), F.length(raw))).otherwise(raw)
    return F.struct(F.coalesce(language, F.lit("")).alias("language"), text.alias("text"))


def stream_delta(current: Column, emitted: Column) -> Column:
    """struct(delta, revised): what ``current`` adds to ``emitted``; revised if it doesn't continue it."""
    current, emitted = F.coalesce(current, F.lit("")), F.coalesce(emitted, F.lit(""))
    goes_on = current.startswith(emitted)
    delta = F.when(goes_on, F.substring(current, F.length(emitted) + 1, F.length(current))).otherwise("")
    return F.when(current == "", F.struct(F.lit("").alias("delta"), F.lit(False).alias("revised"))).otherwise(F.struct(delta.alias("delta"), (~goes_on).alias("revised")))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Code points that both strings begin with; each string is cut into characters once."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(differ, True), F.lit(0)) - 1, n).cast("int"))


def confirm_delta(current: Column, confirmed: Column, pending: Column, final: Column) -> Column:
    """struct(delta, pending, revised): what of ``current`` is confirmed now, and what still waits.

    What the previous pending text and the new rest have in common at the start becomes confirmed; at the end everything.
    """
    current, confirmed, pending = (F.coalesce(x, F.lit("")) for x in (current, confirmed, pending))
    out = lambda d, p, r: F.struct(d.alias("delta"), p.alias("pending"), r.alias("revised"))
    none, goes_on = F.lit(""), current.startswith(confirmed)
    rest = F.substring(current, F.length(confirmed) + 1, F.length(current))
    split = bound(common_prefix_length(pending, rest), lambda n: out(F.substring(rest, F.lit(1), n), F.substring(rest, n + 1, F.length(rest)), F.lit(False)))
    at_end = F.when(goes_on, out(rest, none, F.lit(False))).otherwise(out(none, none, (confirmed != "") | (pending != "")))
    return F.when(current == "", out(none, none, F.lit(False))).when(final, at_end).when(~goes_on, out(none, current, F.lit(True))).otherwise(split)


def merge_metadata(a: Column, b: Column) -> Column:
    """Both maps; ``b`` wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def project_metadata(metadata: Column, keys: list[str]) -> Column:
    """Array of key=value of the listed keys that exist, in their order; booleans as 0 or 1."""
    shown = lambda v: F.when(F.lower(v) == "true", "1").when(F.lower(v) == "false", "0").otherwise(v)
    have = F.filter(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(metadata, k))
    return F.transform(have, lambda k: F.concat(k, F.lit("="), F.coalesce(shown(F.element_at(metadata, k)), F.lit(""))))
