"""Text functions as column expressions.  All stay in the JVM.

Python's ``str.strip`` and ``\\s`` know more white space than Java's; the class
``WS`` below spells theirs out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str`` methods see it, as a Java character class body.
WS = r"\t-\r\x1c-\x20\x85\xa0  -     　"

#: The reference patterns of the contract profile.
QUESTION_HEADER = r"^\s*Question\s*No[.:]?\s*[:.]?\s*([\w/\-]+)"
SECTION_HEADER = r"^\s*(Section\s+\d+[A-Z]?)\b"
CLAUSE_HEADER = r"^\s*(Clause\s+\d+(?:\.\d+)*)\b"
DRAWING_REF = r"(?:Drawing\s*No\.?\s*|Dwg\.?\s*)([\w/\-]+/\d+[A-Z]?)"
CLAUSE_REF = r"(?:Clause|Cl\.?)\s+(\d+(?:\.\d+)*)"
CITATION = r"\[([^\[\]]+?)\s+p\.(\d+)\]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(c, f"[{WS}]+", " "))


def matches(c: Column, pattern: str, group: int = 1, flags: str = "(?iu)") -> Column:
    """All matches of a group, in order."""
    return F.regexp_extract_all(c, F.lit(flags + pattern), F.lit(group))


def references(c: Column, pattern: str) -> Column:
    """The distinct values that a reference rule finds, in order of code points."""
    return F.array_sort(F.array_distinct(matches(c, pattern)))


def last_header(c: Column, pattern: str) -> Column:
    """The last header line of a kind, or null."""
    return F.try_element_at(matches(c, pattern, flags="(?iumd)"), F.lit(-1))


def section_path(c: Column, section: str | None = SECTION_HEADER, clause: str | None = CLAUSE_HEADER) -> Column:
    """The last section and the last clause header of a text, joined."""
    parts = [strip(last_header(c, p)) for p in (section, clause) if p]
    path = F.concat_ws(" > ", *parts) if parts else F.lit("")
    return F.when(path != "", path)


def section_top(path: Column) -> Column:
    """The first part of a section path, if it is a section."""
    head = strip(F.split(path, " > ")[0])
    return F.when(F.lower(head).startswith("section "), head)


def file_stem(path: Column) -> Column:
    """The base name less its last extension, blanks as underscores."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.replace(F.when(base.contains("."), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base), F.lit(" "), F.lit("_"))


def chunk_id(path: Column, page: Column, index: Column) -> Column:
    return F.concat_ws(":", file_stem(path), page.cast("string"), index.cast("string"))


def citations(c: Column) -> Column:
    """``[file p.N]`` marks, in order, as ``file, page``; repeats stay."""
    pair = F.arrays_zip(matches(c, CITATION, 1, "").alias("file"), matches(c, CITATION, 2, "").alias("page"))
    return F.transform(pair, lambda x: F.struct(strip(x["file"]).alias("file"), x["page"].cast("int").alias("page")))


def sentences(c: Column) -> Column:
    """Trimmed sentences: text is cut after a terminator and white space, and at line ends."""
    parts = F.split(strip(c), rf"(?<=[。！？.!?])[{WS}]+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def without_thoughts(c: Column) -> Column:
    """Less what a model thought aloud, closed or not."""
    return strip(F.regexp_replace(F.regexp_replace(c, "(?s)<think>.*?</think>", ""), "(?s)<think>.*$", ""))


def unfenced(c: Column) -> Column:
    """Less a code fence around it."""
    body = F.regexp_replace(strip(c), r"^```(?:json)?", "")
    return strip(F.regexp_replace(strip(body), r"```$", ""))


def caption_of(c: Column) -> Column:
    """``caption, entities`` of a captioner's reply; what is no such object has neither."""
    body = unfenced(c)
    caption = F.get_json_object(body, "$.caption_zh")
    items = F.from_json(F.get_json_object(body, "$.entities"), "array<string>")
    entities = F.coalesce(items, F.array().cast("array<string>"))
    return F.struct(F.coalesce(caption, F.lit("")).alias("caption"), F.when(caption.isNotNull(), entities).otherwise(F.array().cast("array<string>")).alias("entities"))


def judge_score(c: Column) -> Column:
    """The score of a judge's reply, from 0 to 1; null on any defect."""
    score = F.get_json_object(unfenced(c), "$.score").try_cast("double")
    return F.when(score.isNotNull() & ~F.isnan(score), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def last_event_text(c: Column) -> Column:
    """A command-line model's answer: of one object its message or result, else the last text of its event lines."""
    whole = F.coalesce(F.get_json_object(c, "$.message"), F.get_json_object(c, "$.result"))
    of_line = lambda e: F.coalesce(*(F.get_json_object(e, f"$.{k}") for k in ("message", "result", "content", "text")))
    texts = F.filter(F.transform(F.split(c, "\n"), of_line), lambda x: x.isNotNull())
    return F.coalesce(whole, F.try_element_at(texts, F.lit(-1)))


def slug(model: Column, default: str) -> Column:
    """The cache suffix of a model's name; none for the default model."""
    name = F.regexp_replace(F.regexp_replace(model, "[^A-Za-z0-9.-]+", "-"), "^-+|-+$", "")
    return F.when(model.isNull() | (model == default), F.lit("")).otherwise(F.concat(F.lit("."), name))


def safe_name(c: Column) -> Column:
    """Whether a file name stays in its folder."""
    return (c != "") & ~c.contains("/") & ~c.contains("\\") & ~c.contains("..") & ~c.contains("\x00")


#: Printable ASCII, general punctuation, CJK punctuation, ideographs and full-width forms.
EXPECTED = r"\x20-\x7e‐-‧　-〿㐀-䶿一-鿿＀-￯"


def char_ratios(c: Column) -> Column:
    """``alnum, garbled``: shares of the characters that are no white space; null without any."""
    solid = F.regexp_replace(c, f"[{WS}]", "")
    n = F.nullif(F.length(solid), F.lit(0))
    alnum = F.length(F.regexp_replace(solid, r"[^\p{L}\p{N}]", ""))
    garbled = F.length(F.regexp_replace(solid, f"[{EXPECTED}]", ""))
    return F.struct((alnum / n).alias("alnum"), (garbled / n).alias("garbled"))


def cell_texts(html: Column) -> Column:
    """Texts of the cells of a flat table, in order, tags inside them dropped."""
    cells = F.regexp_extract_all(html, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(cells, lambda x: squeeze(F.regexp_replace(x, "<[^>]*>", "")))


def markdown_cell(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def contains_folded(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def indexable(text: Column, caption: Column) -> Column:
    """A chunk's text, with its caption if there is one."""
    return F.when(F.length(caption) > 0, F.concat(text, F.lit("\n\nCaption: "), caption)).otherwise(text)


def preview(text: Column, size: int = 200) -> Column:
    return F.substring(F.replace(strip(text), F.lit("\n"), F.lit(" ")), 1, size)


def gallery_preview(text: Column, size: int = 80) -> Column:
    return markdown_cell(F.substring(squeeze(text), 1, size))


def words(c: Column) -> Column:
    """Lower-case words; ideographs and kana singly, as no dictionary is at hand to join them."""
    single = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
    return F.regexp_extract_all(F.lower(c), F.lit(rf"[a-z0-9_[\p{{L}}\p{{N}}&&[^{single}]]]+|[{single}]"), F.lit(0))
