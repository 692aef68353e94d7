"""Section paths of norm books, by four systems of numbering, from the lines between their tables.

Whether a line can be a heading is told from the lines around it. Which heading it is depends on all headings before it,
as an automaton whose registers hold the numbers; it runs as a prefix scan over the lines of all books, and is set back at
the first line of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.patterns import clean_name
from folioflow.operators.graph import numbered, settled
from folioflow.operators.scans import automaton

# Patterns of headings, of lines of contents and of the line that begins an item.
MARKS = r"(?U)^\s*#{0,6}\s*"
CHAPTER = MARKS + r"第\s*([一-龥]{1,3})\s*章\s*(.*?)\s*$"
SECTION = MARKS + r"([一-龥]{1,3})\s*[、,]\s*(.+?)\s*$"
SUBSECTION = MARKS + r"(\d{1,3})\s*[\.．]\s*([^\.]+?)\s*$"
PARAGRAPH = MARKS + r"[\(【（]\s*(\d*)\s*[\)】）]\s*(.+?)\s*$"
VOLUME = r"(?U)^第\s*([一-龥]{1,3})\s*册(?![一-龥\w])"
CONTENTS = r"(?U)[.…]{2,}\s*\d+\s*$"
WORK = r"(?U)^\s*工作内容"
SENTENCE_END = r"[。；，、：:．·]$"
LETTERS = r"(?U)^\s?##\s+([A-Z](?: ?\.? ?\d+)*)(?:\s+|[　])(.+?)\s*$"
LETTERS_TIGHT = r"(?U)^\s?##\s+([A-Z](?: ?\.? ?\d+)*)([^\s#　\d.].*?)\s*$"
LETTERS_ALONE = r"(?U)^\s?##\s+([A-Z](?: ?\.? ?\d+)*)\s*$"
LETTERS_BARE = r"(?U)^\s?([A-Z](?: ?\.? ?\d+)*)(?:\s+|[　])(.+?)\s*$"
LETTERS_BARE_STRICT = r"(?U)^\s?([A-Z](?: ?\.? ?\d+)+)(?:\s+|[　])([^\s\-<>\[({].*?)\s*$"
NEWLINE = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
MISSING = "X"

#: Levels of the systems: chapters, sections, subsections, paragraphs; with volumes there are volumes and chapters instead
#: of the first.
SYSTEMS = ("letters", "chinese", "mixed", "volumes")


def chinese_number(text: Column) -> Column:
    """A numeral up to 九十九; null for anything else."""
    digit = lambda c: F.position(c, F.lit("零一二三四五六七八九")) - 1
    tens, ones = F.regexp_extract(text, "^([零一二三四五六七八九]?)十[零一二三四五六七八九]?$", 1), F.regexp_extract(text, "十([零一二三四五六七八九]?)$", 1)
    return F.when(text.rlike("^[零一二三四五六七八九]?十[零一二三四五六七八九]?$"), F.when(tens == "", 1).otherwise(digit(tens)) * 10 + F.when(ones == "", 0).otherwise(digit(ones))).when(text.rlike("^[零一二三四五六七八九]$"), digit(text))


def _lines(prefixes: DataFrame) -> DataFrame:
    """(file, table_no, line_no, line, shown): the lines of the prefixes that aren't blank; shown is without marks."""
    each = prefixes.where("file IS NOT NULL AND prefix IS NOT NULL").select("file", "table_no", F.posexplode(F.split("prefix", NEWLINE)).alias("line_no", "raw"))
    each = each.select("file", "table_no", "line_no", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("line")).where("line <> ''")
    return each.withColumn("shown", F.regexp_replace("line", MARKS, ""))


def _lettered(lines: DataFrame, strict: bool) -> DataFrame:
    """Sections A, A.1, ...: on one line with their title, with or without a blank, or right above it."""
    w = Window.partitionBy("file", "table_no").orderBy("line_no")
    line = F.col("line")
    contents = line.rlike(CONTENTS)
    alone = line.rlike(LETTERS_ALONE) & ~line.rlike(LETTERS) & ~line.rlike(LETTERS_TIGHT) & ~contents
    lines = lines.withColumn("contents", contents).withColumn("alone", alone)
    follows = F.coalesce(F.lag("alone").over(w), F.lit(False)) & ~F.startswith(line, F.lit("#")) & ~contents
    lines = lines.withColumn("below", F.lead("line").over(w)).withColumn("below_contents", F.lead("contents").over(w)).withColumn("taken", follows)
    bare = LETTERS_BARE_STRICT if strict else LETTERS_BARE
    heading = lambda pattern, title=None: F.struct(F.regexp_extract(line, pattern, 1).alias("code"), (F.regexp_extract(line, pattern, 2) if title is None else title).alias("title"))
    named = F.when(line.rlike(LETTERS), heading(LETTERS)).when(line.rlike(LETTERS_TIGHT), heading(LETTERS_TIGHT))
    named = named.when(F.col("alone") & F.col("below").isNotNull() & ~F.startswith("below", F.lit("#")) & ~F.col("below_contents"), heading(LETTERS_ALONE, F.col("below")))
    named = named.when(line.rlike(bare), heading(bare))
    found = lines.where("NOT contents AND NOT taken").withColumn("s", named).where("s IS NOT NULL")
    return found.select("file", "table_no", "line_no", F.lit(0).alias("place"), F.regexp_replace("s.code", r"\s+", "").alias("code"), F.trim("s.title").alias("title"))


#: Events of the Chinese systems and what they do in the states: nothing yet, chapter, section, numbered subsection, subsection
#: without a number.
_CHAPTER, _SECTION, _SUBSECTION, _PARAGRAPH, _PARAGRAPH_AFTER_TITLE, _TITLE = range(6)
_CHINESE = [
    [(1, "chapter")] * 5,
    [(1, "chapter"), *[(2, "section")] * 4],
    [(0, None), (1, None), *[(3, "subsection")] * 3],
    [(s, None) for s in range(5)],
    [(0, None), (1, None), (4, None), (3, None), (4, None)],
    [(0, None), (1, None), *[(4, None)] * 3],
]
#: Events with volumes: volume, chapter, section. States: nothing yet, chapter, volume, both.
_VOLUMES = [[(2, "volume"), (3, "volume"), (2, "volume"), (3, "volume")], [(1, "chapter"), (1, "chapter"), (3, "chapter"), (3, "chapter")], [(s, None) for s in range(4)]]


def _restarting(moves: list) -> list:
    """moves, and then the same for rows that begin a book: whatever was before, they act as in state 0. Registers keep what
    they hold, so a state must tell which of them are set."""
    return [*moves, *[[m[0]] * len(m) for m in moves], [(0, None)] * len(moves[0])]


def _scanned(lines: DataFrame, moves: list, registers: list[str]) -> DataFrame:
    """lines (with event and value, null where a line is no heading) with the state and registers before them."""
    counted = settled(numbered(lines, F.col("file"), F.col("table_no"), F.col("line_no")))
    first = counted.groupBy("file").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("first"))
    event = F.when(F.col("first"), F.coalesce(F.col("event") + len(moves), F.lit(2 * len(moves)))).otherwise(F.col("event"))
    counted = counted.join(first, "number", "left").withColumn("move", event).drop("first")
    out = automaton(counted, "number", "move", "value", _restarting(moves), registers)
    begins = F.col("move") >= len(moves)
    return out.withColumn("state", F.when(begins, 0).otherwise(F.col("before.state"))).select("*", *[F.when(~F.coalesce(begins, F.lit(False)), F.col(f"before.{r}")).alias(r) for r in registers])


def _chinese(lines: DataFrame, strict: bool) -> DataFrame:
    """Chapters, sections, subsections and paragraphs. A chapter counts unless another follows before the table; a section
    if an item begins within five lines; the others if the next line begins an item or goes further down. A title above
    an item, or above a paragraph that has no subsection, is a subsection whose number was lost."""
    w = Window.partitionBy("file", "table_no").orderBy("line_no")
    line, shown = F.col("line"), F.col("shown")
    for name, pattern in {"is_chapter": CHAPTER, "is_section": SECTION, "is_subsection": SUBSECTION, "is_paragraph": PARAGRAPH, "is_work": WORK, "is_contents": CONTENTS}.items():
        lines = lines.withColumn(name, line.rlike(pattern))
    plausible = (F.length(shown) <= 30) & (shown != "") & ~shown.rlike(SENTENCE_END) & ~F.contains(shown, F.lit("…")) & ~F.contains(shown, F.lit("<table")) & ~F.contains(shown, F.lit("计量单位")) & ~F.startswith(shown, F.lit("工作内容"))
    for pattern in (CHAPTER, SECTION, SUBSECTION, PARAGRAPH):
        plausible = plausible & ~shown.rlike(pattern)
    lines = lines.withColumn("is_title", plausible)
    ahead = [(F.lead("is_work", k).over(w), F.lead(F.col("is_chapter") | F.col("is_section"), k).over(w)) for k in range(1, 6)]
    near, stopped = F.lit(False), F.lit(False)
    for work, stop in ahead:
        stopped = stopped | F.coalesce(stop, F.lit(False)) if strict else stopped
        near = near | (F.coalesce(work, F.lit(False)) & ~stopped)
    lower = F.lead(F.col("is_paragraph") | F.col("is_work") | (F.col("is_subsection") & F.lit(not strict))).over(w)
    whole = Window.partitionBy("file", "table_no")
    lines = lines.withColumn("near", near).withColumn("leads", F.coalesce(lower, F.lit(False))).withColumn("item_next", F.coalesce(F.lead("is_work").over(w), F.lit(False)))
    lines = lines.withColumn("next_shown", F.lead("shown").over(w)).withColumn("title_above", F.when(F.lag("is_title").over(w), F.lag("shown").over(w))).withColumn("last_chapter", F.max(F.when(F.col("is_chapter"), F.col("line_no"))).over(whole) == F.col("line_no"))
    chapter_no, section_no = chinese_number(F.regexp_extract(line, CHAPTER, 1)), chinese_number(F.regexp_extract(line, SECTION, 1))
    own = F.regexp_extract(line, CHAPTER, 2)
    lines = lines.withColumn("chapter_title", F.when(own != "", own).otherwise(F.trim("next_shown"))).withColumn("chapter_no", chapter_no).withColumn("section_no", section_no)
    whole_sentence = shown.rlike(SENTENCE_END) & F.lit(strict)
    number = F.regexp_extract(line, SUBSECTION, 1).try_cast("int")
    paragraph = F.regexp_extract(line, PARAGRAPH, 1).try_cast("int")
    is_ = lambda c: F.col(f"is_{c}")
    heading = F.when(is_("chapter"), F.when(F.col("chapter_no").isNotNull() & (F.col("chapter_title") != "") & F.col("last_chapter"), _CHAPTER))
    heading = heading.when(is_("section"), F.when(F.col("section_no").isNotNull() & ~whole_sentence & F.col("near"), _SECTION))
    heading = heading.when(is_("subsection"), F.when(~whole_sentence & F.col("leads"), _SUBSECTION))
    heading = heading.when(is_("paragraph"), F.when(F.col("item_next"), F.when(F.col("title_above").isNotNull(), _PARAGRAPH_AFTER_TITLE).otherwise(_PARAGRAPH)))
    heading = heading.when(is_("title") & F.col("item_next"), _TITLE)
    value = F.when(is_("chapter"), F.col("chapter_no")).when(is_("section"), F.col("section_no")).when(is_("subsection"), number).when(is_("paragraph"), paragraph)
    lines = lines.select("file", "volume", "table_no", "line_no", "shown", "title_above", "chapter_title", F.when(~is_("contents"), heading).alias("event"), value.alias("value"))
    at = _scanned(lines, _CHINESE, ["chapter", "section", "subsection"])
    event, state = F.col("event"), F.col("state")
    code = lambda *parts: F.concat_ws(".", "volume", *[p.cast("string") for p in parts])
    c, s, n, x = F.col("chapter"), F.col("section"), F.col("value"), F.lit(MISSING)
    sub = F.when(state == 4, x).otherwise(F.col("subsection").cast("string"))
    one = lambda place, code_, title: F.struct(F.lit(place).alias("place"), code_.alias("code"), title.alias("title"))
    paragraph_code = code(c, s, sub, F.when((state == 4) | n.isNull(), x).otherwise(n.cast("string")))
    made = F.when(event == _CHAPTER, F.array(one(0, code(n), F.col("chapter_title"))))
    made = made.when((event == _SECTION) & (state == 0), F.array(one(0, code(n), F.col("shown")))).when(event == _SECTION, F.array(one(0, code(c, n), F.col("shown"))))
    made = made.when((event == _SUBSECTION) & (state >= 2), F.array(one(0, code(c, s, n), F.col("shown"))))
    made = made.when(event.isin(_PARAGRAPH, _PARAGRAPH_AFTER_TITLE) & (state >= 3), F.array(one(0, paragraph_code, F.col("shown"))))
    made = made.when((event == _PARAGRAPH_AFTER_TITLE) & (state == 2), F.array(one(0, code(c, s, x), F.col("title_above")), one(1, code(c, s, x, x), F.col("shown"))))
    made = made.when((event == _TITLE) & (state >= 2), F.array(one(0, code(c, s, x), F.col("shown"))))
    return at.select("file", "table_no", "line_no", F.inline(made))


def _with_volumes(lines: DataFrame) -> DataFrame:
    """Volumes, chapters and numbered sections; a code counts once between two tables."""
    line, shown = F.col("line"), F.trim("shown")
    contents = line.rlike(r"[.…]{2,}")
    volume, chapter = chinese_number(F.regexp_extract(shown, VOLUME, 1)), chinese_number(F.regexp_extract(line, CHAPTER, 1))
    title = F.regexp_extract(line, CHAPTER, 2)
    event = F.when(shown.rlike(VOLUME), F.when(volume > 0, 0)).when(line.rlike(CHAPTER), F.when(chapter.isNotNull() & (title != ""), 1)).when(line.rlike(SUBSECTION), 2)
    value = F.when(shown.rlike(VOLUME), volume).when(line.rlike(CHAPTER), chapter).otherwise(F.regexp_extract(line, SUBSECTION, 1).try_cast("int"))
    lines = lines.select("file", "table_no", "line_no", F.when(line.rlike(CHAPTER), title).otherwise(shown).alias("title"), F.when(~contents, event).alias("event"), value.alias("value"))
    at = _scanned(lines, _VOLUMES, ["volume", "chapter"])
    v, n = F.when(F.col("state") >= 2, F.col("volume").cast("string")).otherwise("0"), F.col("value").cast("string")
    code = F.when(F.col("event") == 1, F.concat_ws(".", v, n)).when((F.col("event") == 2) & F.col("state").isin(1, 3), F.concat_ws(".", v, F.col("chapter").cast("string"), n))
    found = at.withColumn("code", code).where("code IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("file", "table_no", "code").orderBy("line_no"))
    return found.withColumn("first", first).where("first = 1").select("file", "table_no", "line_no", F.lit(0).alias("place"), "code", "title")


def sections(prefixes: DataFrame, system: str, strict: bool = False, once: bool = False, skip_dotted: bool = False) -> DataFrame:
    """(file, table_no, line_no, place, code, name) of the headings in prefixes (file, table_no, prefix, and volume where the
    system is chinese): headings stand in the order of table_no, line_no and place.

    system is one of SYSTEMS; mixed books are chinese ones whose volume is BJ. strict refuses whole sentences, rules that stand
    between other rules, and lettered lines without a number. once keeps the first heading of each code in a book, and
    skip_dotted leaves out titles that end in dots. Null files and prefixes, and blank lines, have no headings; a null volume is
    left out of codes.
    """
    if system not in SYSTEMS:
        raise ValueError(f"no such system of sections: {system}")
    lines = _lines(prefixes)
    if system == "letters":
        found = _lettered(lines, strict)
    elif system == "volumes":
        found = _with_volumes(lines)
    else:
        volumes = prefixes.select("file", "table_no", (F.lit("BJ") if system == "mixed" else F.col("volume")).alias("volume"))
        found = _chinese(lines.join(volumes, ["file", "table_no"]), strict)
    if skip_dotted:
        found = found.where(~F.contains("title", F.lit("…")) & ~F.col("title").rlike(r"\.{2,}"))
    if once:
        kept = found.groupBy("file", "code").agg(F.min(F.struct("table_no", "line_no", "place", "title")).alias("s"))
        found = kept.select("file", "s.table_no", "s.line_no", "s.place", "code", "s.title")
    return found.select("file", "table_no", "line_no", "place", "code", clean_name(F.col("title")).alias("name"))
