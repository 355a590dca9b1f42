"""Column functions on text. Lengths are of UTF-16 code units where limits are stated in them, of code points elsewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: white space that a trim strips, CJK characters, hidden tags, wrapper tags, finish reasons
SPACE = r"\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CJK = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"
HIDDEN = ["think", "thinking", "analysis", "reasoning", "scratchpad", "internal_thought"]
WRAPPERS = ["正文", "now_plot", "content"]
TRUNCATED = ["length", "max_token", "max_tokens", "max_output_tokens", "token_limit", "output_token_limit"]


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def utf16_length(c: Column) -> Column:
    """Characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def token_estimate(c: Column) -> Column:
    """A token for each CJK character and for each four of the rest."""
    cjk = F.regexp_count(c, F.lit(CJK)).cast("long")
    return cjk + F.ceil((utf16_length(c) - cjk) / 4)


def _paired(tag: str) -> str:
    return rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"


def visible_text(text: Column, is_user: Column) -> Column:
    """What a reader sees: user text trimmed; other text without comments, hidden tags and reasoning details, cut down to
    the bodies of the first wrapper that has any, at most one blank line at a time."""
    shown = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    for tag in HIDDEN:
        shown = F.regexp_replace(shown, _paired(tag), " ")
    shown = F.regexp_replace(shown, r"(?is)<details(?:\s[^>]*)?>\s*<summary(?:\s[^>]*)?>[^<]*(?:思考|推理|analysis|reasoning).*?</details\s*>", " ")
    bodies = [F.filter(F.transform(F.regexp_extract_all(shown, F.lit(_paired(tag)), 1), trim), lambda x: x != "") for tag in WRAPPERS]
    wrapped = F.coalesce(*(F.when(F.size(b) > 0, F.array_join(b, "\n\n")) for b in bodies), shown)
    return F.when(is_user, trim(text)).otherwise(trim(F.regexp_replace(wrapped, r"\n{3,}", "\n\n")))


def summary_text(raw: Column, tag: str = "log_summary") -> Column:
    """A summariser's answer without code fence and wrapper tag; null where nothing is left."""
    c = trim(F.regexp_replace(F.regexp_replace(trim(raw), r"(?i)^```(?:text|markdown|md)?\s*", ""), r"\s*```$", ""))
    c = F.regexp_replace(F.regexp_replace(c, rf"(?i)^<{tag}>\s*", ""), rf"(?i)\s*</{tag}>$", "")
    return F.nullif(trim(F.regexp_replace(c, rf"(?i)</?{tag}>", "")), F.lit(""))


def replace_persona(text: Column, persona: str, source: Column, label: str = "the user") -> Column:
    """The user's display name, unless the source itself has it, by a neutral label."""
    return text if len(persona.strip()) < 2 else F.when(source.contains(persona.strip()), text).otherwise(F.replace(text, F.lit(persona.strip()), F.lit(label)))


def truncated(finish_reason: Column, manually_edited: Column) -> Column:
    reason = F.regexp_replace(F.lower(trim(finish_reason)), r"[\s-]+", "_")
    return ~F.coalesce(manually_edited, F.lit(False)) & F.coalesce(reason.isin(TRUNCATED), F.lit(False))


def escaped(c: Column) -> Column:
    """Angle brackets full-width, at most one blank line at a time, trimmed."""
    return trim(F.regexp_replace(F.translate(c, "<>", "＜＞"), r"\n{3,}", "\n\n"))


def summary_block(text: Column, start: Column, end: Column, level: Column, tag: str = "log_summary") -> Column:
    source = F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("messages "), start.cast("string"), F.lit("-"), end.cast("string")))
    body = F.concat_ws("\n", F.lit(f"<{tag}>"), F.concat(F.lit("level L"), F.greatest(F.lit(1), level).cast("string")), source, trim(text), F.lit(f"</{tag}>"))
    return F.when(trim(text) == "", F.lit("")).otherwise(body)


def tagged_blocks(c: Column, tag: str) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>"), 0)


def bounded_error(c: Column, most: int = 500) -> Column:
    return F.substring(trim(F.regexp_replace(c, r"\s+", " ")), 1, most)


def redacted(c: Column, secrets: list[str]) -> Column:
    for s in secrets:
        if s:
            c = F.replace(c, F.lit(s), F.lit("[REDACTED]"))
    return c


def range_key(level: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", level.cast("string"), start.cast("string"), end.cast("string"))


def trimmed_distinct(c: Column) -> Column:
    """Array without blanks and repetitions, first places kept."""
    return F.array_distinct(F.filter(F.transform(c, trim), lambda x: x != ""))


def earlier_phase(text: Column, phase: str, cues: str, recall: str, matter: str) -> Column:
    """Whether a text asks for what came before: names a past phase near a cue, either way round, or recalls the matter of
    it. The four are patterns, by language."""
    near = "{0,32}"
    return F.coalesce(text.rlike(f"(?:{phase}).{near}(?:{cues})") | text.rlike(f"(?:{cues}).{near}(?:{phase})") | text.rlike(rf"(?:{recall}).{{0,20}}(?:{matter})"), F.lit(False))


def phase_boundary(text: Column, rules: list[str], hypothetical: str, negated: str, sentence_end: str = "。！？\n") -> Column:
    """Whether the first match of some rule stands in a sentence that is neither hypothetical nor negated. Sentences end at
    the marks of sentence_end and nowhere else."""
    found = F.lit(False)
    for rule in rules:
        at = F.regexp_instr(text, F.lit(f"({rule})"))
        upto = F.substr(text, F.lit(1), at - 1 + F.length(F.regexp_substr(text, F.lit(rule))))
        before = F.substr(text, F.lit(1), at - 1)
        start = F.length(F.regexp_extract(before, rf"(?s)^(.*[{sentence_end}])", 1))
        sentence = F.substr(upto, start + 1)
        found = found | F.coalesce((at > 0) & ~sentence.rlike(hypothetical) & ~sentence.rlike(negated), F.lit(False))
    return found
