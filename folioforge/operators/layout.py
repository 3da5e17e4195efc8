"""Styles, column blocks and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rng
from ..functions.text import font_url, vertical_digits

# Fixed style values.
FONTS = [
    ("BIZ UDGothic", "sans-serif"), ("BIZ UDPGothic", "sans-serif"), ("Dela Gothic One", "sans-serif"), ("DotGothic16", "sans-serif"),
    ("IBM Plex Sans JP", "sans-serif"), ("Kiwi Maru", "serif"), ("Kosugi", "sans-serif"), ("Kosugi Maru", "sans-serif"),
    ("M PLUS 1", "sans-serif"), ("M PLUS 1p", "sans-serif"), ("M PLUS 2", "sans-serif"), ("M PLUS Rounded 1c", "sans-serif"),
    ("Mochiy Pop One", "sans-serif"), ("Mochiy Pop P One", "sans-serif"), ("Murecho", "sans-serif"), ("Noto Sans JP", "sans-serif"),
    ("Rampart One", "sans-serif"), ("RocknRoll One", "sans-serif"), ("Sawarabi Gothic", "sans-serif"), ("Shippori Antique", "sans-serif"),
    ("Shippori Antique B1", "sans-serif"), ("Stick", "sans-serif"), ("Yusei Magic", "sans-serif"), ("Zen Kaku Gothic Antique", "sans-serif"),
    ("Zen Kaku Gothic New", "sans-serif"), ("Zen Kurenaido", "sans-serif"), ("Zen Maru Gothic", "sans-serif"), ("BIZ UDMincho", "serif"),
    ("BIZ UDPMincho", "serif"), ("Hina Mincho", "serif"), ("Kaisei Decol", "serif"), ("Kaisei HarunoUmi", "serif"), ("Kaisei Opti", "serif"),
    ("Kaisei Tokumin", "serif"), ("New Tegomin", "serif"), ("Noto Serif JP", "serif"), ("Shippori Mincho", "serif"), ("Shippori Mincho B1", "serif"),
    ("Yuji Boku", "serif"), ("Yuji Mai", "serif"), ("Yuji Syuku", "serif"), ("Zen Antique", "serif"), ("Zen Antique Soft", "serif"), ("Zen Old Mincho", "serif"),
    ("Hachi Maru Pop", "cursive"), ("Klee One", "cursive"), ("M PLUS 1 Code", "monospace"), ("Potta One", "system-ui"), ("Reggae One", "system-ui"),
]
BACKGROUNDS = ["#ffffff", "#fafafa", "#fdfbf7", "#f0f0f0", "#fffff0"]
FIGURE_BACKGROUNDS = ["#eef", "#efe", "#fee", "#f0f8ff", "#faf0e6"]
TEXT_COLORS = ["#000000", "#1a1a1a", "#333333"]
RULE_COLORS = ["#dddddd", "#cccccc", "#aaaaaa", "#888888", "#666666", "#333333"]
DECORATIONS, BORDERS, ALIGNMENTS = ["left", "bottom", "none"], ["solid", "double", "dashed"], ["left", "center"]


def with_style(docs: DataFrame) -> DataFrame:
    """Adds the style fields to documents (id, is_vertical, column_count); the rule depends on the drawn column count, not the document's."""
    key = F.col("id")
    draw = lambda name, a, b: rng.randint(name, key, a, b).cast("int")
    pick = lambda name, values: rng.choice(name, key, values)
    font = pick("font", [f for f, _ in FONTS])
    rule_cols, rule_width, background = draw("rule_cols", 1, 3), draw("rule_width", 0, 2), pick("bg", BACKGROUNDS)
    rule = F.when((rule_cols > 1) & (rule_width > 0), F.concat(rule_width.cast("string"), F.lit("px solid "), pick("rule_color", RULE_COLORS))).otherwise("none")
    out = docs.withColumns(
        {
            "writing_mode": F.when(F.col("is_vertical"), "vertical-rl").otherwise("horizontal-tb"),
            "padding": draw("padding", 30, 60),
            "font_family": F.concat(F.lit("'"), font, F.lit("', "), pick("font", [g for _, g in FONTS])),
            "font_url": font_url(font),
            "base_font_size": draw("font_size", 18, 24),
            "line_height": ((rng.h("line_height", key) * 4000 / 4294967296.0 + 16000) / 10000).cast("double"),
            "bg_color": background,
            "figure_bg_color": F.when(rng.u("figure_bg", key) > 0.5, pick("figure_color", FIGURE_BACKGROUNDS)).otherwise(background),
            "text_color": pick("text_color", TEXT_COLORS),
            "column_gap": draw("gap", 35, 60),
            "rule_style": rule,
            "h1_decoration": pick("h1", DECORATIONS),
            "h1_border_style": pick("h1_border", BORDERS),
            "h1_border_width": draw("h1_width", 2, 6),
            "image_alignment": pick("align", ALIGNMENTS),
            "show_title": rng.h("show_title", key) % 4 == 0,
        }
    ).withColumn("line_height", F.round("line_height", 1))
    side = 800 + 200 * (F.col("column_count") - 1)
    # limits in whole numbers: a third of the side, and the column's width times (2 + columns - 1) / 3
    a = F.floor(side / 3)
    free = side - 2 * F.col("padding") - F.col("column_gap") * (F.col("column_count") - 1)
    b = F.floor(free * (F.col("column_count") + 1) / (3 * F.col("column_count")))
    out = out.withColumn("max_img_limit", rng.randint("img_limit", key, F.least(a, b), F.greatest(a, b)).cast("int"))
    return out.withColumns({"viewport_width": F.when(F.col("is_vertical"), 100).otherwise(side).cast("int"), "viewport_height": F.when(F.col("is_vertical"), side).otherwise(100).cast("int")})


def with_overrides(styled: DataFrame, **fields: Column) -> DataFrame:
    """Style fields set from outside where the value is not null; the writing mode follows the orientation, limits drawn before stay."""
    out = styled.withColumns({name: F.coalesce(value, F.col(name)) for name, value in fields.items()})
    return out.withColumn("writing_mode", F.when(F.col("is_vertical"), "vertical-rl").otherwise("horizontal-tb"))


def span_all(is_vertical: Column, width: Column, height: Column, key: Column) -> Column:
    """Portrait images of vertical and landscape images of horizontal documents span all columns half the time."""
    fits = (is_vertical & (height > width)) | (~is_vertical & (width > height))
    return fits & (rng.u("span", key) < 0.5)


def layout_blocks(elements: DataFrame) -> DataFrame:
    """Block number and kind of every element row (id, is_vertical, pos, type, span_all).

    In vertical documents a spanning image closes the open block and is a block of its own.
    """
    w = Window.partitionBy("id").orderBy("pos")
    full = (F.col("is_vertical") & (F.col("type") == "image") & F.coalesce("span_all", F.lit(False))).cast("int")
    keyed = elements.withColumn("folio_full", full).withColumn("folio_island", 2 * F.sum("folio_full").over(w) - F.col("folio_full"))
    block = (F.dense_rank().over(Window.partitionBy("id").orderBy("folio_island")) - 1).cast("int")
    return keyed.withColumn("block", block).withColumn("kind", F.when(F.col("folio_full") == 1, "fullwidth").otherwise("multicolumn")).drop("folio_full", "folio_island")


#: Rules of a page; names in braces are style fields or the derived ones of page_fields.
PAGE_RULES = """html{height:100%;margin:0}
body{margin:0;padding:{padding}px;background-color:{bg_color};color:{text_color};font-family:{font_family};writing-mode:{writing_mode};text-orientation:mixed;box-sizing:border-box;{page_size}}
h1{font-size:{title_size}px;font-weight:700;margin-left:10px;margin-bottom:30px;flex-shrink:0;{title_line}}
.content-body{column-count:{column_count};column-gap:{column_gap}px;column-rule:{rule_style};font-size:{base_font_size}px;line-height:{line_height};text-align:justify;column-fill:balance;{body_size}}
p{margin-top:0;margin-bottom:1em;text-indent:1em}
.tcy{text-combine-upright:all;font-family:{font_family};margin:2px 0}
figure{display:block;margin:0;padding:5px;background-color:{figure_bg_color};text-align:{image_alignment};break-inside:avoid;box-sizing:border-box;{figure_size}}
figure.span-all{text-align:center;{span_size}}
.content-image{display:block;max-width:100%;max-height:100%;width:auto;height:auto;object-fit:contain;margin-inline:{image_margin}}
figure.span-all .content-image{margin-inline:auto}
figcaption{font-size:0.9em;margin-top:5px;margin-bottom:5px;line-height:1.4}"""


def page_fields() -> dict[str, Column]:
    """What the rules need beside the style: sizes by orientation, the heading's line, the images' margin."""
    tall, px = F.col("is_vertical"), lambda c: F.concat(c.cast("string"), F.lit("px"))
    inner = F.concat(F.lit("height:calc(100vh - "), px(2 * F.col("padding")), F.lit(");width:auto"))
    line = F.concat_ws(" ", px(F.col("h1_border_width")), "h1_border_style", "text_color")
    side = lambda edge, pad: F.concat(F.lit(f"border-{edge}:"), line, F.lit(f";padding-{edge}:{pad}px"))
    left, bottom = F.when(tall, side("top", 15)).otherwise(side("left", 15)), F.when(tall, side("left", 10)).otherwise(side("bottom", 10))
    spanning = F.concat(inner, F.lit(";margin:0 "), px(F.col("column_gap")), F.lit(";display:flex;flex-direction:column;align-items:center;justify-content:center;padding:20px"))
    return {
        "page_size": F.when(tall, "height:100%;width:auto").otherwise("height:auto;min-height:100%;width:100%"),
        "title_size": (2 * F.col("base_font_size")).cast("string"),
        "title_line": F.when(F.col("h1_decoration") == "left", left).when(F.col("h1_decoration") == "bottom", bottom).otherwise(""),
        "body_size": F.when(tall, inner).otherwise("width:100%;display:block"),
        "figure_size": F.when(tall, "max-height:100%;max-width:100%;width:auto;height:auto;margin-left:auto;margin-right:auto").otherwise("width:100%;height:auto"),
        "span_size": F.when(tall, spanning).otherwise("column-span:all;width:100%;height:auto;margin:30px 0;padding:10px"),
        "image_margin": F.when(F.col("image_alignment") == "center", "auto").otherwise("0"),
    }


def _filled(template: str, fields: dict[str, Column]) -> Column:
    """A template with its names in braces replaced."""
    parts = re.split(r"\{([a-z_0-9]+)\}", template)
    return F.concat(*[F.lit(p) if k % 2 == 0 else fields.get(p, F.col(p)).cast("string") for k, p in enumerate(parts)])


def page_body(elements: str = "elements") -> Column:
    """Paragraphs and figures with their places as data-id, in blocks: in vertical documents a spanning image ends the columns and stands between them.

    Contents and captions are inserted as they are, in vertical documents with short numbers upright; a figure without a caption has no caption line.
    """
    tall, limit = F.col("is_vertical"), F.concat(F.col("max_img_limit").cast("string"), F.lit("px"))
    upright = lambda c: F.when(tall, vertical_digits(c)).otherwise(c)
    spans = lambda e: (e["type"] == "image") & F.coalesce(e["span_all"], F.lit(False))
    alone = lambda i: F.get(elements, i).isNull() | (tall & spans(F.get(elements, i)))  # noqa: E731  beyond either end, too

    def piece(e: Column, i: Column) -> Column:
        caption = F.when(F.coalesce(e["caption"], F.lit("")) != "", F.concat(F.lit("<figcaption>"), upright(e["caption"]), F.lit("</figcaption>"))).otherwise("")
        bound = F.when(tall & spans(e), F.concat(F.lit("max-height:90%;max-width:"), limit)).when(tall, F.concat(F.lit("max-width:"), limit)).otherwise(F.concat(F.lit("max-height:"), limit))
        figure = F.concat(F.lit('<figure class="'), F.when(spans(e), "span-all").otherwise("normal"), F.lit('" data-id="'), i.cast("string"), F.lit('"><img src="'), F.coalesce(e["src"], F.lit("")), F.lit('" class="content-image" style="'), bound, F.lit('">'), caption, F.lit("</figure>"))
        inner = F.when(e["type"] == "text", F.concat(F.lit('<p data-id="'), i.cast("string"), F.lit('">'), upright(F.coalesce(e["content"], F.lit(""))), F.lit("</p>"))).otherwise(figure)
        opening, closing = F.when(alone(i - 1), '<div class="content-body">').otherwise(""), F.when(alone(i + 1), "</div>").otherwise("")
        return F.when(tall & spans(e), inner).otherwise(F.concat(opening, inner, closing))

    return F.array_join(F.transform(elements, piece), "\n")


def render_html(pages: DataFrame) -> DataFrame:
    """id and html of styled documents (see with_style) with title and elements; null elements make an empty body."""
    head = F.concat(F.lit('<!DOCTYPE html>\n<html lang="ja">\n<head><meta charset="UTF-8"><link href="'), F.col("font_url"), F.lit('" rel="stylesheet"><style>\n'), _filled(PAGE_RULES, page_fields()), F.lit("\n</style></head>\n<body>\n"))
    title = F.when(F.col("show_title"), F.concat(F.lit('<h1 data-id="title">'), F.coalesce("title", F.lit("")), F.lit("</h1>\n"))).otherwise("")
    return pages.select("id", F.concat(head, title, F.coalesce(page_body(), F.lit("")), F.lit("\n</body>\n</html>")).alias("html"))
