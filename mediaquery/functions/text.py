"""Column expressions over file names, titles, subtitles and messages."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, patterns, labels and messages that results must carry unchanged.
SPACE = r"\t\n\x{0b}\f\r\x{1c}\x{1d}\x{1e}\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CJK = r"\x{4e00}-\x{9fff}"
WIDE = rf"[{CJK}\x{{10000}}-\x{{10ffff}}]"
DIGIT = r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
NAME_ERROR = "expected filename: 一级品类-二级品类_@作者_市场_语言_note_id.mp4"
NOTE_ERROR = "missing note_id"
BANNED_TITLE_TERMS = ("全网最强", "不看后悔", "精彩内容", "此生必去")
LANGUAGE_LABELS = {"en": "英语", "zh_traditional": "中文（繁体）", "zh": "中文（简体）", "unknown": "未知语言"}
MESSAGE_PATTERNS = (
    (r"^timeline starts with gap:\s*(.+)$", "时间线开头存在空隙：$1"),
    (r"^gap:\s*(.+)$", "时间线存在空隙：$1"),
    (r"^insufficient unique candidates:\s*(.+)$", "唯一候选不足：$1"),
    (r"^insufficient distinct source videos:\s*(.+)$", "不同源视频数量不足：$1"),
    (r"^voiceover must contain at least two sentences$", "口播文案必须至少包含两句话"),
    (r"^asset is not registered:\s*(.+)$", "素材未注册：$1"),
)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(col: Column) -> Column:
    """Blank-normalised text: one plain blank between words, none at the ends."""
    return F.trim(F.regexp_replace(col, f"[{SPACE}]+", " "))


def _group(col: Column, pattern: str, group: int = 1) -> Column:
    """A capture group, null when the pattern does not match."""
    return F.when(F.regexp_like(col, F.lit(pattern)), F.regexp_extract(col, pattern, group))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?s)^(.+)\.[^.]+$", "$1")


def author_key(path: Column, video_id: Column) -> Column:
    stem = file_stem(path)
    found = F.coalesce(_group(stem, r"(@[^*]+)\*"), _group(stem, r"_(@[^_]+)_"))
    return F.coalesce(strip(found), video_id.cast("string"))


def author_display(path: Column) -> Column:
    stem = file_stem(path)
    found = F.coalesce(_group(stem, r"(@[^*_]+(?:[^*]*?))\*"), _group(stem, r"_(@[^_]+)_"))
    return F.coalesce(strip(found), F.lit("unknown"))


def author_overlay_name(path: Column) -> Column:
    stem = file_stem(path)
    tail = F.regexp_replace(_group(stem, r"(?s)(@.*)$"), r"_[0-9a-fA-F]{24}$", "")
    trimmed = F.regexp_replace(tail, r"(_[^_]*){1,2}$", "")
    return F.coalesce(strip(F.coalesce(_group(stem, r"(@[^*]+)\*"), trimmed)), F.lit(""))


def material_name_parts(path: Column) -> Column:
    """Struct of the six file-name parts plus ``error`` (null when the name parses)."""
    stem = file_stem(path)
    whole = r"(?s)^(.*)_([^_]*)_([^_]*)_([^_]*)$"
    head = _group(stem, whole, 1)
    block, author = _group(head, r"(?s)^(.*?)_@(.*)$", 1), _group(head, r"(?s)^(.*?)_@(.*)$", 2)
    parent, sub = _group(block, r"(?s)^([^-]*)-(.*)$", 1), _group(block, r"(?s)^([^-]*)-(.*)$", 2)
    note = _group(stem, whole, 4)
    error = F.when(parent.isNull(), NAME_ERROR).when(note == "", NOTE_ERROR)

    def part(col: Column, name: str) -> Column:
        return F.when(error.isNull(), strip(col)).alias(name)

    return F.struct(
        part(parent, "parent_category"), part(sub, "source_category"),
        F.when(error.isNull(), F.concat(F.lit("@"), strip(author))).alias("author"),
        part(_group(stem, whole, 2), "market"), part(_group(stem, whole, 3), "language"),
        part(note, "note_id"), error.alias("error"),
    )


def language_label(language: Column) -> Column:
    raw = F.coalesce(language.cast("string"), F.lit(""))
    code = F.replace(F.lower(strip(raw)), F.lit("_"), F.lit("-"))
    return (
        F.when(code.startswith("en"), LANGUAGE_LABELS["en"])
        .when(code.isin("zh-tw", "zh-hk", "zh-hant"), LANGUAGE_LABELS["zh_traditional"])
        .when(code.startswith("zh"), LANGUAGE_LABELS["zh"])
        .otherwise(strip(F.when(raw == "", LANGUAGE_LABELS["unknown"]).otherwise(raw)))
    )


def safe_component(value: Column, fallback: str) -> Column:
    cleaned = F.regexp_replace(strip(F.coalesce(value.cast("string"), F.lit(""))), r"[/:\\\x00]", "_")
    return F.when(cleaned == "", fallback).otherwise(cleaned)


def draft_name(path: Column, video_id: Column, category: Column, language: Column, run_id: Column, index: Column) -> Column:
    stem = file_stem(F.coalesce(path, F.lit("")))
    prefix = F.regexp_replace(stem, r"(?s)(_@|\*@).*$", "")
    fallback = F.coalesce(category.cast("string"), F.lit("unknown"))
    level2, level3 = F.regexp_replace(prefix, r"(?s)-.*$", ""), _group(prefix, r"(?s)^[^-]*-(.*)$")
    level2 = F.when(level2 == "", fallback).otherwise(level2)
    hex_id = r"([0-9a-fA-F]{24})$"
    owner = F.coalesce(video_id.cast("string"), F.lit(""))
    note = F.coalesce(_group(stem, "_" + hex_id), _group(owner, hex_id), F.when(owner == "", "unknown").otherwise(owner))
    version = F.coalesce(_group(run_id.cast("string"), r"(?i)(?:^|-)v(\d+)$"), F.lit("1"))
    return F.concat_ws(
        "-", safe_component(level2, "unknown"), safe_component(F.coalesce(level3, fallback), "unknown"),
        safe_component(note, "unknown"), safe_component(language_label(language), LANGUAGE_LABELS["unknown"]),
        F.concat(F.lit("v"), version),
        F.when(index < 1000, F.lpad(index.cast("string"), 3, "0")).otherwise(index.cast("string")),
    )


def cover_title_errors(title: Column, minimum: int = 6, maximum: int = 16) -> Column:
    compact = F.char_length(F.regexp_replace(title, f"[{SPACE}，。！？,.!?]", ""))
    banned = F.lit(False)
    for term in BANNED_TITLE_TERMS:
        banned = banned | F.contains(title, F.lit(term))
    return F.array_compact(F.array(
        F.when(~compact.between(minimum, maximum), f"cover title must contain {minimum}-{maximum} characters"),
        F.when(F.regexp_count(title, F.lit("\n")) > 1, "cover title must use at most two lines"),
        F.when(banned, "cover title contains prohibited generic or exaggerated copy"),
    ))


def split_cover_title(title: Column, max_lines: int = 2) -> Column:
    text = F.replace(strip(title), F.lit("\n"), F.lit(""))
    size = F.char_length(text)
    half = F.floor(size / 2).cast("int")
    halves = F.array(F.substring(text, F.lit(1), half), F.substring(text, half + 1, size))
    return F.when((F.lit(max_lines) == 1) | (size <= 9), F.array(text)).otherwise(halves)


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[。！？.!?]+"), lambda s: strip(s) != ""))


def voiceover_errors(text: Column) -> Column:
    return F.array_compact(F.array(
        F.when(strip(text) == "", "continuous two-sentence product voiceover is required"),
        F.when(sentence_count(text) < 2, "voiceover must contain at least two sentences"),
    ))


def localized_message(error: Column) -> Column:
    out = None
    for pattern, replacement in MESSAGE_PATTERNS:
        hit = F.regexp_like(error, F.lit("(?i)" + pattern))
        value = F.regexp_replace(error, "(?i)" + pattern, replacement)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(error)


def display_units(text: Column) -> Column:
    return F.char_length(text) + F.regexp_count(text, F.lit(WIDE))


def wrap_text(text: Column, maximum_units: int = 28) -> Column:
    """Greedy wrap on words, or on characters where the text has no blank."""
    normal = squeeze(text)
    if maximum_units <= 0:
        return normal

    @F.pandas_udf("string")
    def wrapped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else "\n".join(_wrapped_lines(t, maximum_units)))

    return wrapped(normal)


def _wrapped_lines(text: str, maximum_units: int) -> list[str]:
    """Lines of a blank-normalised text, a wide character counting two units; every token is looked at once."""
    sep = " " if " " in text else ""
    tokens = text.split(" ") if sep else list(text)
    widths = [len(t) for t in tokens]
    if any(map(_is_wide, text)):
        widths = [w + sum(map(_is_wide, t)) for w, t in zip(widths, tokens)]
    lines, start, units = [], 0, -len(sep)
    for i, width in enumerate(widths):
        units += len(sep) + width
        if units > maximum_units and i > start:
            lines.append(sep.join(tokens[start:i]))
            start, units = i, width
    return [*lines, sep.join(tokens[start:])]


def _is_wide(char: str) -> bool:
    return "\u4e00" <= char <= "\u9fff" or char >= "\U00010000"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row: a list of one binds it, an outer expression is evaluated per use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def semantic_chunks(text: Column, maximum_chars: int = 14, maximum_words: int = 8) -> Column:
    """Subtitle-sized pieces: word groups per sentence for Latin text, clauses otherwise."""
    return _once(strip(text), lambda body: _chunks(body, maximum_chars, maximum_words))


def _chunks(body: Column, maximum_chars: int, maximum_words: int) -> Column:
    latin = F.regexp_count(body, F.lit("[A-Za-z]")) > F.regexp_count(body, F.lit(f"[{CJK}]"))
    sentences = F.filter(
        F.transform(F.split(body, f"(?<=[.!?])[{SPACE}]+"), squeeze), lambda s: s != ""
    )

    def by_words(sentence: Column) -> Column:
        def grouped(words: Column) -> Column:
            groups = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / maximum_words).cast("int"))
            return F.transform(groups, lambda i: F.array_join(F.slice(words, i * maximum_words + 1, maximum_words), " "))

        return _once(F.split(sentence, " "), grouped)

    solid = F.regexp_replace(body, f"[{SPACE}]+", "")
    clauses = F.filter(
        F.flatten(F.transform(F.split(solid, "[。！？!?；;]+"), lambda s: F.split(s, "[，,、]+"))), lambda c: c != ""
    )

    def halve(clause: Column) -> Column:
        size = F.char_length(clause)
        half = F.floor(size / 2).cast("int")
        return F.when(size <= maximum_chars, F.array(clause)).otherwise(
            F.array(F.substring(clause, F.lit(1), half), F.substring(clause, half + 1, size))
        )

    def without_short_tail(pieces: Column) -> Column:
        count = F.size(pieces)
        tail_short = (count >= 2) & (F.char_length(F.try_element_at(pieces, F.lit(-1))) <= 2)
        merged = F.concat(
            F.slice(pieces, F.lit(1), F.greatest(count - 2, F.lit(0))),
            F.array(F.concat(F.try_element_at(pieces, F.lit(-2)), F.try_element_at(pieces, F.lit(-1)))),
        )
        return F.when(tail_short, merged).otherwise(pieces)

    pieces = F.flatten(F.transform(clauses, halve))
    return F.when(latin, F.flatten(F.transform(sentences, by_words))).otherwise(_once(pieces, without_short_tail))


def speech_weight(text: Column) -> Column:
    return F.greatest(
        F.lit(1.0),
        F.regexp_count(text, F.lit(f"[{CJK}]")) + F.regexp_count(text, F.lit("[A-Za-z]+")) * 1.4
        + F.regexp_count(text, F.lit(f"[{DIGIT}]")) * 1.2,
    )


def text_density(text: Column, seconds: Column) -> Column:
    return solid_length(text) / F.greatest(F.lit(1.0), seconds)


def solid_length(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"[{SPACE}]+", ""))


def transcript_segments(raw: Column) -> Column:
    """Segments of ``[start][Sn]text[end]`` markup, optionally inside a JSON envelope with ``text``."""
    body = strip(raw)
    is_object = F.try_parse_json(body).isNotNull() & F.startswith(body, F.lit("{"))
    text = F.when(is_object, F.coalesce(F.get_json_object(body, "$.text"), F.lit(""))).otherwise(body)
    mark = r"(?s)\[(\d+(?:\.\d+)?)\]\[(S\d+)\](.*?)\[(\d+(?:\.\d+)?)\]"
    parts = [F.regexp_extract_all(text, F.lit(mark), F.lit(i)) for i in (1, 2, 3, 4)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("s", "w", "t", "e"))])
    return F.transform(zipped, lambda z: F.struct(
        z["s"].cast("double").alias("start"), z["e"].cast("double").alias("end"),
        z["w"].alias("speaker"), strip(z["t"]).alias("text"),
    ))


def unfence_json(text: Column) -> Column:
    """JSON text without a surrounding code fence; null where it does not parse."""
    body = strip(text)
    inner = F.regexp_replace(F.regexp_replace(body, r"^```[^\n]*\n?", ""), r"\n?```[ \t]*$", "")
    cleaned = F.when(F.startswith(body, F.lit("```")), inner).otherwise(body)
    return F.when(F.try_parse_json(cleaned).isNotNull(), cleaned)


def render_template(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), value.cast("string"))
    return out
