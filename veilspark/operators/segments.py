"""Texts cut into segments with their context: paragraphs, keys and values, headings, neighbours; HTML as text; shapes on slides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Pattern, find_spans
from .intervals import overlap_join

#: Fixed value: keys that make a line a value whatever their length.
KEYS = [
    "nama", "nama lengkap", "nama pasien", "nama karyawan", "nama pelanggan", "nik", "no ktp", "nomor ktp", "no. ktp", "npwp", "no npwp", "nomor npwp", "kk", "no kk", "nomor kk",
    "kartu keluarga", "alamat", "address", "domisili", "telepon", "telp", "no telp", "no hp", "nomor hp", "phone", "handphone", "email", "e-mail", "surel", "tanggal lahir", "tgl lahir",
    "ttl", "tempat lahir", "jenis kelamin", "gender", "pekerjaan", "occupation", "agama", "religion", "no rekening", "nomor rekening", "bank account", "bpjs", "no bpjs", "sim", "no sim",
    "paspor", "passport", "no paspor",
]


def paragraphs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, idx, text, start_pos): paragraphs between blank lines, trimmed; where there is one at most, the lines."""
    clean = df.select(key, F.regexp_replace(text, r"\r\n?", "\n").alias("_t"))
    block = Pattern("P", r"(?U)\S(?:(?!\n\s*\n)[\s\S])*", 1.0)
    line = Pattern("L", r"(?U)[^\s](?:[^\n]*[^\s])?", 1.0)
    parts = find_spans(clean, "_t", [block, line])
    trimmed = parts.withColumn("value", F.regexp_replace("value", r"(?U)\s+$", ""))
    n = F.count_if(F.col("pattern_no") == 0).over(Window.partitionBy(key))
    kept = trimmed.withColumn("_n", n).where(F.col("pattern_no") == F.when(F.col("_n") <= 1, 1).otherwise(0))
    idx = F.row_number().over(Window.partitionBy(key).orderBy("start_pos")) - 1
    return kept.select(key, idx.cast("long").alias("idx"), F.col("value").alias("text"), "start_pos")


#: Styles of headings, distances on slides in EMU, words of labels.
HEADING_STYLES = ["Heading 1", "Heading 2", "Heading 3", "Heading 4", "Heading 5", "Heading 6", "Title", "Subtitle", "Heading1", "Heading2", "Heading3", "Heading4", "TOC Heading", "TOCHeading"]
LEFT_GAP, ABOVE_GAP, BASELINE = 2_743_200, 457_200, 228_600
LABEL_WORDS = ["nama", "nik", "npwp", "telepon", "alamat", "email", "name", "phone", "address", "id", "no.", "nomor"]


def key_label(text: Column, most: int = 25) -> Column:
    """The key of a paragraph such as ``key: value`` or ``key = value``, or null."""
    shape = r"^(.{1,30}?)\s*[:=]\s*(.+)$"
    key = F.trim(F.regexp_extract(text, shape, 1))
    return F.when(text.rlike(shape) & (F.length(key) <= most), key)


def with_headings(paragraphs_: DataFrame, document: str, order: str = "idx") -> DataFrame:
    """Paragraphs (document, order, text, style) with is_heading and the text of the last heading before them; a heading has none of its own."""
    is_heading = F.col("style").isin(HEADING_STYLES)
    before = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    flagged = paragraphs_.withColumn("is_heading", F.coalesce(is_heading, F.lit(False)))
    return flagged.withColumn("heading", F.when(~F.col("is_heading"), F.last_value(F.when(F.col("is_heading"), F.trim("text")), True).over(before)))


def with_table_headers(cells: DataFrame, *table: str) -> DataFrame:
    """Cells (table..., row, col, text) with table_header (row 0 of the column) and row_header (column 0 of the row), trimmed; cells that are headers
    themselves have none."""
    top = Window.partitionBy(*table, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = Window.partitionBy(*table, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = lambda axis, w: F.first_value(F.when(F.col(axis) == 0, F.trim("text")), True).over(w)
    full = lambda c: F.when(c != "", c)
    out = cells.withColumn("table_header", F.when(F.col("row") > 0, full(first("row", top)))).withColumn("row_header", F.when(F.col("col") > 0, full(first("col", left))))
    return out.withColumn("is_header", (F.col("row") == 0) | (F.col("col") == 0))


#: What a segment has besides its text, by name: the type of the column and the value where a format has none.
SEGMENT_COLUMNS = {
    "file_type": "string", "heading": "string", "table_headers": "array<string>", "row_headers": "array<string>", "column_index": "int", "slide_title": "string", "nearby_labels": "array<string>",
    "key_label": "string", "is_value_of_key": "boolean", "is_header": "boolean", "previous_text": "string", "next_text": "string", "sheet": "string", "cell": "string",
}


def as_segments(df: DataFrame, file_type: str) -> DataFrame:
    """Rows of any format as segments (id, file_id, text and SEGMENT_COLUMNS): columns that are there keep their values, the others are null; headers of a
    column or row become lists of one."""
    def made(name: str, kind: str) -> Column:
        one = {"table_headers": "table_header", "row_headers": "row_header"}.get(name)
        if name == "file_type":
            return F.lit(file_type)
        if name == "is_value_of_key":
            return F.col("key_label").isNotNull() if "key_label" in df.columns else F.lit(False)
        if name in df.columns:
            return F.col(name).cast(kind)
        if one in df.columns:
            return F.when(F.col(one).isNotNull(), F.array(one)).otherwise(F.array().cast(kind))
        return F.lit(None).cast(kind)

    return df.select("id", "file_id", "text", *[made(name, kind).alias(name) for name, kind in SEGMENT_COLUMNS.items()])


def is_potential_label(text: Column) -> Column:
    """Whether a text is short enough for a label: 30 characters and 4 words, and either one word of 20 or 25 characters in all."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    clean = F.regexp_replace(F.regexp_replace(bare, r":+$", ""), r"(?U)\s+$", "")
    words = F.size(F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != ""))
    return F.coalesce((bare != "") & (F.length(clean) <= 30) & (words <= 4) & (F.length(clean) <= 25), F.lit(False))


def is_label_like(text: Column) -> Column:
    """Whether a text reads like a label: it ends with a colon, is short with a label's word in it, or is all in capitals."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    word = (F.length(bare) <= 20) & F.lower(bare).rlike("|".join(w.replace(".", r"\.") for w in LABEL_WORDS))
    capitals = bare.rlike(r"\p{Lu}") & ~bare.rlike(r"\p{Ll}") & (F.length(bare) <= 30)
    return F.coalesce((text != "") & (F.length(text) <= 50) & (bare.rlike("[:：]$") | word | capitals), F.lit(False))


#: Width of the narrowest grid cells, in the units of slides.
CELL = 1 << 20


def _near(a: DataFrame, b: DataFrame, slide: str, aside: Column, over: Column) -> DataFrame:
    """Boxes of ``a`` and ``b`` (x_, y_, width_, height_ with the suffix a or b) of a slide that lie within ``aside`` and ``over`` of each other, found in the cells of a grid."""
    reach = {"_x0": F.col("x_a") - aside, "_x1": F.col("x_a") + F.col("width_a") + aside, "_y0": F.col("y_a") - over, "_y1": F.col("y_a") + F.col("height_a") + over}
    own = {"_u0": F.col("x_b"), "_u1": F.col("x_b") + F.col("width_b"), "_v0": F.col("y_b"), "_v1": F.col("y_b") + F.col("height_b")}
    met = overlap_join(a.withColumns(reach), b.withColumns(own), [slide], [("_x0", "_x1"), ("_y0", "_y1")], [("_u0", "_u1"), ("_v0", "_v1")], CELL)
    return met.drop(*reach, *own)


def nearby_labels(shapes: DataFrame, slide: str, most: int = 3) -> DataFrame:
    """(slide, shape, labels) for shapes (slide, shape, text, x, y, width, height) with labels near: the best ``most`` by score, those to the left before those
    above and on the same line; equal texts count once."""
    box = lambda p: shapes.select(slide, *[F.col(c).alias(f"{c}_{p}") for c in ("shape", "text", "x", "y", "width", "height")])
    # what can score: a label to the left or near on a line, or above, or centred within its own width
    aside_of, over_of = F.greatest(F.lit(2 * LEFT_GAP), F.col("width_a")) + 1, F.lit(max(ABOVE_GAP, 2 * LEFT_GAP, BASELINE) + 1)
    pairs = _near(box("a").where(is_potential_label(F.col("text_a"))), box("b"), slide, aside_of, over_of).where("shape_a <> shape_b")
    middle = lambda p, c, size: F.col(f"{c}_{p}") + F.col(f"{size}_{p}") / 2
    ax, ay, bx, by = middle("a", "x", "width"), middle("a", "y", "height"), middle("b", "x", "width"), middle("b", "y", "height")
    line = F.abs(ay - by) <= BASELINE
    aside, over = F.col("x_b") - F.col("x_a") - F.col("width_a"), F.col("y_b") - F.col("y_a") - F.col("height_a")
    meets = (F.col("x_a") < F.col("x_b") + F.col("width_b")) & (F.col("x_a") + F.col("width_a") > F.col("x_b"))
    far = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    score = (
        F.when((ax < bx) & line & aside.between(0, LEFT_GAP), 100.0 - aside / LEFT_GAP * 50)
        .when((ay < by) & (meets | (F.abs(ax - bx) <= F.col("width_a"))) & over.between(0, ABOVE_GAP), 80.0 - over / ABOVE_GAP * 30)
        .when(line & (far <= 2 * LEFT_GAP), 50.0 - far / LEFT_GAP * 25)
    )
    best = Window.partitionBy(slide, "shape_b").orderBy(F.desc("score"), "shape_a")
    few = pairs.withColumn("score", score).where("score is not null").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most)
    clean = F.trim(F.regexp_replace(F.trim("text_a"), r":+$", ""))
    return few.groupBy(slide, F.col("shape_b").alias("shape")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_n", clean.alias("t")))), lambda x: x["t"])).alias("labels"))


def slide_title(shapes: DataFrame, slide: str) -> DataFrame:
    """(slide, title): the first potential label among the five topmost shapes."""
    order = Window.partitionBy(slide).orderBy("y", "shape")
    top = shapes.withColumn("_n", F.row_number().over(order)).where((F.col("_n") <= 5) & is_potential_label(F.col("text")))
    return top.groupBy(slide).agg(F.trim(F.min_by("text", "_n")).alias("title"))


def flattened(parts: DataFrame, document: str, order: str = "idx") -> DataFrame:
    """(document, text): parts in order, a line each; a part with a header stands behind it as ``header: value``."""
    line = F.when(F.coalesce(F.col("header") != "", F.lit(False)), F.concat("header", F.lit(": "), "text")).otherwise(F.col("text"))
    one = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return parts.where("text <> ''").groupBy(document).agg(F.array_join(F.transform(one, lambda x: x["t"]), "\n").alias("text"))


def key_value(text: Column, most: int = 25) -> Column:
    """struct(key, value) of a line such as ``key: value``, or null."""
    shape = r"^(.{1,30}?)\s*[:=|]\s*(.+)$"
    key, value = F.trim(F.regexp_extract(text, shape, 1)), F.trim(F.regexp_extract(text, shape, 2))
    return F.when(text.rlike(shape) & (F.lower(key).isin(KEYS) | (F.length(key) <= most)), F.struct(key.alias("key"), value.alias("value")))


def with_context(segments: DataFrame, key: str) -> DataFrame:
    """Segments (key, idx, text) with the texts before and behind, and the heading that directly precedes."""
    order = Window.partitionBy(key).orderBy("idx")
    t, behind = F.col("text"), F.lead("text").over(order)
    upper = t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}") & (F.length(t) > 3)
    title = t.rlike(r"^[^\p{L}]*(?:\p{Lu}\p{Ll}*[^\p{L}]+)*\p{Lu}\p{Ll}*[^\p{L}]*$") & (F.size(F.split(F.trim(t), r"\s+")) <= 5)
    short = ~t.endswith(".") & (F.length(t) <= 40) & (F.length(behind) > 2 * F.length(t))
    heading = (F.length(t) <= 50) & (upper | title | F.coalesce(short, F.lit(False)))
    flagged = segments.withColumn("previous_text", F.lag("text").over(order)).withColumn("next_text", behind).withColumn("is_header", heading)
    return flagged.withColumn("heading", F.when(F.lag("is_header").over(order), F.lag("text").over(order)))


def html_to_text(html: Column, most: int = 2_000_000) -> Column:
    """Scripts and styles out, line ends for breaks and blocks, tags out, the named and ASCII entities resolved, blanks squeezed."""
    out = F.left(html, F.lit(most))
    for p, to in ((r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|li|tr|h[1-6])>", "\n"), (r"<[^>]+>", "")):
        out = F.regexp_replace(out, p, to)
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(to))
    for p, to in ((r"[ \t\r\f\x0b]+", " "), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, p, to)
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def runs_map(runs: DataFrame, paragraph: str) -> DataFrame:
    """Runs (paragraph, run, text) with the range of the paragraph's text that each covers; empty runs have none."""
    order = Window.partitionBy(paragraph).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    full = runs.where(F.length("text") > 0)
    return full.withColumn("logical_end", F.sum(F.length("text")).over(order)).withColumn("logical_start", F.col("logical_end") - F.length("text"))


def source_ranges(mapped: DataFrame, spans: DataFrame, paragraph: str) -> DataFrame:
    """The part of each run that a span (paragraph, start_pos, end_pos) covers. Spans meet the runs near them only, however many a paragraph has."""
    met = overlap_join(mapped.select(paragraph, "run", "logical_start", "logical_end"), spans.select(paragraph, "start_pos", "end_pos"), [paragraph], [("logical_start", "logical_end")], [("start_pos", "end_pos")])
    first, last = F.greatest("logical_start", "start_pos"), F.least("logical_end", "end_pos")
    return met.select(paragraph, "start_pos", "end_pos", "run", (first - F.col("logical_start")).alias("source_start"), (last - F.col("logical_start")).alias("source_end"))


def label_relations(shapes: DataFrame, slide: str, near: int = 914_400, level: int = 50_000) -> DataFrame:
    """Pairs of shapes (slide, shape, x, y, width, height) of a slide that are near: relation, distance and confidence."""
    box = lambda p: shapes.select(slide, *[F.col(c).alias(f"{c}_{p}") for c in ("shape", "x", "y", "width", "height")])
    pairs = _near(box("a"), box("b"), slide, F.lit(near + 1), F.lit(near + 1)).where("shape_a <> shape_b")
    right, bottom = (lambda p: F.col(f"x_{p}") + F.col(f"width_{p}")), (lambda p: F.col(f"y_{p}") + F.col(f"height_{p}"))
    dx = F.greatest(F.col("x_b") - right("a"), F.col("x_a") - right("b"), F.lit(0))
    dy = F.greatest(F.col("y_b") - bottom("a"), F.col("y_a") - bottom("b"), F.lit(0))
    distance = F.sqrt(dx * dx + dy * dy)
    middle = lambda p, c, size: F.col(f"{c}_{p}") + F.col(f"{size}_{p}") / 2
    line = F.abs(middle("a", "y", "height") - middle("b", "y", "height")) <= level
    column = F.abs(middle("a", "x", "width") - middle("b", "x", "width")) <= level
    relation = (
        F.when(line, F.when(right("b") <= F.col("x_a"), "left_of").when(F.col("x_b") >= right("a"), "right_of").otherwise("same_line"))
        .when(column, F.when(bottom("b") <= F.col("y_a"), "above").when(F.col("y_b") >= bottom("a"), "below").otherwise("same_column")).otherwise("adjacent")
    )
    base = F.create_map(*[F.lit(v) for kv in {"left_of": 0.9, "above": 0.8, "same_line": 0.7, "same_column": 0.6, "right_of": 0.4, "below": 0.3, "adjacent": 0.5}.items() for v in kv])
    kept = pairs.withColumn("distance", distance).where(F.col("distance") <= near).withColumn("relation", relation)
    return kept.select(slide, "shape_a", "shape_b", "relation", F.round("distance", 3).alias("distance"), F.round(F.element_at(base, F.col("relation")) * (1 - F.col("distance") / near), 6).alias("confidence"))


def value_below(shapes: DataFrame, labels: Column, slide: str, aside: int = 500_000) -> DataFrame:
    """For each label shape the nearest shape below it: at most ``aside`` to the side, least sum of distances.

    The next value below in a label's own strip, ``aside`` wide, is at most ``aside`` farther than the nearest, so only what lies that deep is looked at; a label whose strip
    has none below looks down to the slide's last shape.
    """
    strip = lambda x: F.floor(x / F.lit(float(max(aside, 1)))).alias("_strip")
    lab = shapes.where(labels).select(slide, F.col("shape").alias("label_shape"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    val = shapes.where(~labels).select(slide, F.col("shape").alias("value_shape"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    down = Window.partitionBy(slide, "_strip").orderBy("_y")
    both = lab.select(slide, strip(F.col("lx")), F.col("ly").alias("_y"), "label_shape", "lx", "ly").unionByName(val.select(slide, strip(F.col("vx")), F.col("vy").alias("_y"), F.col("vy").alias("_vy")), allowMissingColumns=True)
    # a range frame that begins behind the label's own height
    below = F.min("_vy").over(down.rangeBetween(1, Window.unboundedFollowing))
    deepest = val.groupBy(F.col(slide).alias("_slide")).agg(F.max("vy").alias("_deepest"))
    reach = both.withColumn("_next", below).where(F.col("label_shape").isNotNull()).join(deepest, F.col(slide) == F.col("_slide"))
    depth = F.least(F.coalesce(F.col("_next") + aside, F.col("_deepest")), F.col("_deepest")) + 1
    looked = reach.select(slide, "label_shape", "lx", "ly", (F.col("lx") - aside - 1).alias("_x0"), (F.col("lx") + aside + 1).alias("_x1"), F.col("ly").alias("_y0"), depth.alias("_y1")).where("_y1 > _y0")
    points = val.withColumns({"_u0": F.col("vx"), "_u1": F.col("vx"), "_v0": F.col("vy"), "_v1": F.col("vy")})
    met = overlap_join(looked, points, [slide], [("_x0", "_x1"), ("_y0", "_y1")], [("_u0", "_u1"), ("_v0", "_v1")], CELL)
    met = met.where((F.col("vy") > F.col("ly")) & (F.abs(F.col("vx") - F.col("lx")) <= aside)).withColumn("d", F.abs(F.col("vx") - F.col("lx")) + F.col("vy") - F.col("ly"))
    return met.groupBy(slide, "label_shape").agg(F.min(F.struct("d", "value_shape")).alias("m")).select(slide, "label_shape", "m.value_shape", F.col("m.d").alias("distance"))


def key_value_any(text: Column) -> Column:
    """struct(key, value) by the first of four separators (colon, equals, tab, bar) whose key has 50 characters at most and is no number."""
    bare = F.trim(text)
    out = None
    for shape in (r"^([^:]+):\s*(.+)$", r"^([^=]+)=\s*(.+)$", r"^([^\t]+)\t+(.+)$", r"^([^|]+)\|\s*(.+)$"):
        key, value = F.trim(F.regexp_extract(bare, shape, 1)), F.trim(F.regexp_extract(bare, shape, 2))
        good = bare.rlike(shape) & (F.length(key) <= 50) & ~key.rlike(r"^\d+$")
        found = F.when(good, F.struct(key.alias("key"), value.alias("value")))
        out = found if out is None else F.coalesce(out, found)
    return out


def table_delimiter(lines: Column) -> Column:
    """The first of comma, tab, bar and semicolon that cuts every line into one number of parts above 1; null for less than two lines."""
    out = F.when(F.size(lines) < 2, None)
    for d in (",", "\t", "|", ";"):
        counts = F.array_distinct(_parts(lines, d))
        out = out.when((F.size(counts) == 1) & (F.get(counts, F.lit(0)) > 1), d)
    return out


def _parts(lines: Column, delimiter: str) -> Column:
    return F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit(""))) + 1)
