"""Style sheets as data: rules with their selectors and declarations, the context of a selector, what becomes of each declaration.

One parser in Arrow batches turns a sheet into rows; everything after it is an expression over those rows, so that the decisions of a
whole library are one CASE and their counts one aggregation. Nothing is written back: the sheet is put together again from the rows.

Defined results: comments and what cannot be read are skipped as a style sheet reader does; a null or empty sheet has no rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions import scalars as S
from folioworks.session import spread

# Elements and names that tell a selector's context.
VECTOR_TAGS = ["svg", "math", "image"]
VECTOR_NAMESPACES = ["svg", "math", "m", "mml", "mathml"]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
ROOT_TAGS = ["html", "body"]
IMAGE_TAGS = ["img", "svg", "image", "figure", "picture", "video", "object", "embed", "canvas"]
DROP_CAP_ELEMENTS = ["first-letter", "first-line"]
DROP_CAP_NAME = r"(?i)(?:drop|initial)[-_]?cap|first[-_]?letter"
IMAGE_NAME = r"(?i)cover|title[-_]?page|image|img|figure|illus|photo|picture"
LEGACY_PSEUDO_ELEMENTS = ["first-letter", "first-line", "before", "after"]

# Properties by what is decided about them.
SIDES = ["top", "right", "bottom", "left"]
LOGICAL = ["block", "block-start", "block-end", "inline", "inline-start", "inline-end"]
COLOUR_PROPERTIES = [
    "color", "background-color", "border-color", *[f"border-{s}-color" for s in [*SIDES, *LOGICAL]], "outline-color", "text-decoration-color", "text-emphasis-color", "column-rule-color", "caret-color",
    "accent-color", "scrollbar-color", "-webkit-text-fill-color", "-webkit-text-stroke-color", "-webkit-text-stroke", "-webkit-tap-highlight-color", "text-shadow", "box-shadow", "-webkit-box-shadow", "-moz-box-shadow",
]
COLOUR_SHORTHANDS = ["background", "border", *[f"border-{s}" for s in [*SIDES, *LOGICAL]], "outline", "text-decoration", "text-emphasis", "column-rule", "-webkit-column-rule"]
SPACING = ["line-height", "letter-spacing", "word-spacing"]
HYPHENATION = [
    "hyphens", "-webkit-hyphens", "-moz-hyphens", "-ms-hyphens", "-epub-hyphens", "adobe-hyphenate", "hyphenate-character", "-webkit-hyphenate-character", "hyphenate-limit-chars",
    "-webkit-hyphenate-limit-before", "-webkit-hyphenate-limit-after", "-webkit-hyphenate-limit-lines",
]
ALIGNMENT = ["text-align", "text-align-last"]
BODY_ALIGNMENTS = ["justify", "left", "start", "auto", "inherit", "initial", "unset"]
FIXED_SIZES = ["width", "height", "min-width", "min-height", "max-height", "inline-size", "block-size", "min-inline-size", "min-block-size", "max-block-size"]
BOXES = [f"{p}{s}" for p in ("margin", "padding") for s in ["", *[f"-{x}" for x in [*SIDES, *LOGICAL]]]]
ROOT_LAYOUT = [*BOXES, "width", "min-width", "max-width", "inline-size", "min-inline-size", "max-inline-size", *[f"{p}{c}" for p in ("", "-webkit-", "-epub-") for c in ("column-count", "column-width", "columns", "column-gap")]]
PAGE_MARGINS = [f"{p}{s}" for p in ("margin", "padding") for s in ["", *[f"-{x}" for x in SIDES]]]
SEMANTIC = ["font-weight", "font-style", "font-variant", "font-variant-caps", "text-decoration", "text-decoration-line", "text-transform"]
MONOSPACE = [
    "monospace", "ui-monospace", "courier", "courier new", "courier prime", "courier std", "consolas", "menlo", "monaco", "lucida console", "lucida sans typewriter", "andale mono", "dejavu sans mono",
    "liberation mono", "source code pro", "fira code", "fira mono", "inconsolata", "sf mono", "roboto mono", "ubuntu mono", "noto sans mono", "pt mono", "cousine",
]
VIEWPORT_UNITS = "vw|vh|vmin|vmax|vi|vb|svw|svh|lvw|lvh|dvw|dvh"
SIZE_WORDS = ["xx-small", "x-small", "small", "medium", "large", "x-large", "xx-large", "xxx-large", "larger", "smaller"]
STRETCH_WORDS = ["ultra-condensed", "extra-condensed", "condensed", "semi-condensed", "semi-expanded", "expanded", "extra-expanded", "ultra-expanded"]
SYSTEM_WORDS = ["caption", "icon", "menu", "message-box", "small-caption", "status-bar", "inherit", "initial", "unset", "revert", "revert-layer"]
# The colour names of CSS.
COLOUR_NAMES = (
    "aliceblue antiquewhite aqua aquamarine azure beige bisque black blanchedalmond blue blueviolet brown burlywood cadetblue chartreuse chocolate coral cornflowerblue cornsilk crimson cyan darkblue darkcyan "
    "darkgoldenrod darkgray darkgreen darkgrey darkkhaki darkmagenta darkolivegreen darkorange darkorchid darkred darksalmon darkseagreen darkslateblue darkslategray darkslategrey darkturquoise darkviolet "
    "deeppink deepskyblue dimgray dimgrey dodgerblue firebrick floralwhite forestgreen fuchsia gainsboro ghostwhite gold goldenrod gray green greenyellow grey honeydew hotpink indianred indigo ivory khaki "
    "lavender lavenderblush lawngreen lemonchiffon lightblue lightcoral lightcyan lightgoldenrodyellow lightgray lightgreen lightgrey lightpink lightsalmon lightseagreen lightskyblue lightslategray "
    "lightslategrey lightsteelblue lightyellow lime limegreen linen magenta maroon mediumaquamarine mediumblue mediumorchid mediumpurple mediumseagreen mediumslateblue mediumspringgreen mediumturquoise "
    "mediumvioletred midnightblue mintcream mistyrose moccasin navajowhite navy oldlace olive olivedrab orange orangered orchid palegoldenrod palegreen paleturquoise palevioletred papayawhip peachpuff peru "
    "pink plum powderblue purple rebeccapurple red rosybrown royalblue saddlebrown salmon sandybrown seagreen seashell sienna silver skyblue slateblue slategray slategrey snow springgreen steelblue tan teal "
    "thistle tomato transparent turquoise violet wheat white whitesmoke yellow yellowgreen currentcolor"
).split()

#: The rule groups of each level.
GROUPS = ["colours", "fonts", "sizes", "spacing", "hyphenation", "alignment", "dimensions", "layout", "margins", "heading_sizes_only", "plain_drop_caps"]
LEVELS = {"light": GROUPS[:2], "standard": GROUPS[:9], "strict": GROUPS}

# ---- the parser ----

_CHUNK = re.compile(r"url\(\s*[^\"'()\s][^()\"']*\)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|/\*.*?(?:\*/|$)|[{};()\[\]:,]|\\.|(?:(?!url\()[^\"'/{};()\[\]:,\\])+|/|u", re.S | re.I)
_COMBINATOR = re.compile(r"\s*[>+~]\s*|\s+")
_SIMPLE = re.compile(r"(?P<ns>(?:[\w*-]+)?\|)?(?P<tag>[A-Za-z_][\w-]*|\*)|\.(?P<cls>-?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*)|#(?P<id>[\w\u0080-\U0010ffff-]+)|(?P<colons>::?)(?P<pseudo>[\w-]+)(?P<args>\([^()]*(?:\([^()]*\)[^()]*)*\))?|(?P<attr>\[[^\]]*\])")


def _pieces(css: str) -> list[str]:
    return [c for c in _CHUNK.findall(css) if not c.startswith("/*")]


def _blocks(pieces: list[str]) -> Iterator[tuple[str, list[str] | None]]:
    """(prelude, content) of each statement; the content is None where it ends in a semicolon."""
    prelude, content, depth, round_ = [], [], 0, 0
    for c in pieces:
        if depth:
            depth += (c == "{") - (c == "}")
            if depth:
                content.append(c)
            else:
                yield "".join(prelude).strip(), content
                prelude, content = [], []
            continue
        round_ = max(0, round_ + (c in "([") - (c in ")]")) if len(c) == 1 else round_
        if c == "{" and not round_:
            depth = 1
        elif c == ";" and not round_:
            if (p := "".join(prelude).strip()).startswith("@"):
                yield p, None
            prelude = []
        elif c != "}":
            prelude.append(c)
    if depth:
        yield "".join(prelude).strip(), content


def _declarations(pieces: list[str]) -> list[dict]:
    out, now, depth = [], [], 0
    for c in [*pieces, ";"]:
        depth = max(0, depth + (c in "([{") - (c in ")]}")) if len(c) == 1 else depth
        if c != ";" or depth:
            now.append(c)
            continue
        name, colon, value = "".join(now).partition(":")
        name, value, now = name.strip().lower(), value.strip(), []
        if colon and re.fullmatch(r"-{0,2}[a-z_][\w-]*", name) and value:
            bare = re.sub(r"\s*!\s*important\s*$", "", value, flags=re.I)
            out.append({"property": name, "value": bare, "important": bare != value})
    return out


def _selector(text: str) -> dict | None:
    """One complex selector; None where a compound cannot be read."""
    compounds, at, fresh, text = [], 0, True, text.strip()
    if not text:
        return None
    while at < len(text):
        if (m := _COMBINATOR.match(text, at)) and m.end() > at:
            at, fresh = m.end(), True
            continue
        m = _SIMPLE.match(text, at)
        if not m or m.end() == at:
            return None
        if fresh:
            compounds.append({"tag": None, "namespace": None, "classes": [], "ids": [], "pseudo_classes": [], "pseudo_elements": []})
            fresh = False
        c = compounds[-1]
        if m["tag"]:
            c["tag"] = None if m["tag"] == "*" else m["tag"].lower()
            c["namespace"] = m["ns"][:-1].lower() or None if m["ns"] else None
        elif m["cls"]:
            c["classes"].append(m["cls"])
        elif m["id"]:
            c["ids"].append(m["id"])
        elif m["pseudo"]:
            name = m["pseudo"].lower()
            c["pseudo_elements" if m["colons"] == "::" or name in LEGACY_PSEUDO_ELEMENTS else "pseudo_classes"].append(name)
        at = m.end()
    return {"text": text, "compounds": compounds} if compounds else None


def _selectors(prelude: str) -> list[dict]:
    parts, now, depth = [], [], 0
    for c in [*_pieces(prelude), ","]:
        depth = max(0, depth + (c in "([") - (c in ")]")) if len(c) == 1 else depth
        if c == "," and not depth:
            parts.append("".join(now))
            now = []
        else:
            now.append(c)
    return [s for s in map(_selector, parts) if s]


def parse_sheet(css: str, condition: str = "") -> Iterator[dict]:
    """Rules in order: condition (the at-rules around it), at_rule (null for style rules), prelude, selectors, declarations."""
    for prelude, content in _blocks(_pieces(css)):
        if not prelude.startswith("@"):
            yield {"condition": condition, "at_rule": None, "prelude": prelude, "selectors": _selectors(prelude), "declarations": _declarations(content or [])}
            continue
        word = re.match(r"@([\w-]*)", prelude)[1].lower()
        if word in ("media", "supports") and content is not None:
            yield from parse_sheet("".join(content), f"{condition} and {prelude}" if condition else prelude)
        else:
            yield {"condition": condition, "at_rule": word, "prelude": prelude, "selectors": [], "declarations": _declarations(content or [])}


_COMPOUND = "struct<tag:string,namespace:string,classes:array<string>,ids:array<string>,pseudo_classes:array<string>,pseudo_elements:array<string>>"


def style_rules(df: DataFrame, key: str, css: str) -> DataFrame:
    """One row per rule: key, rule_no, condition, at_rule, prelude, selectors (text, compounds), declarations (property, value, important)."""

    schema = f"{key} {dict(df.dtypes)[key]}, rule_no int, condition string, at_rule string, prelude string, selectors array<struct<text:string,compounds:array<{_COMPOUND}>>>, declarations array<struct<property:string,value:string,important:boolean>>"
    names = pa.list_(pa.string())
    compound = pa.struct([("tag", pa.string()), ("namespace", pa.string()), ("classes", names), ("ids", names), ("pseudo_classes", names), ("pseudo_elements", names)])
    kinds = {"condition": pa.string(), "at_rule": pa.string(), "prelude": pa.string(), "selectors": pa.list_(pa.struct([("text", pa.string()), ("compounds", pa.list_(compound))])), "declarations": pa.list_(pa.struct([("property", pa.string()), ("value", pa.string()), ("important", pa.bool_())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[dict]] = {}
        for batch in batches:
            owner, number, rows = [], [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                if text not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[text] = list(parse_sheet(text))
                owner += [at] * len(known[text])
                number += range(1, len(known[text]) + 1)
                rows += known[text]
            cols = [pa.array([r[n] for r in rows], t) for n, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), *cols], names=[key, "rule_no", *kinds])

    return spread(df.select(key, css)).mapInArrow(run, schema)


# ---- selectors ----


def selector_rows(rules: DataFrame, key: str, root_classes: Column | None = None, root_ids: Column | None = None) -> DataFrame:
    """One row per selector: key, rule_no, selector_no, selector, subject (its last compound), and the flags vector, drop_cap, root, heading, image.
    ``root_classes`` and ``root_ids`` are the names that only root elements use."""
    none = F.array().cast("array<string>")
    rc, ri = root_classes if root_classes is not None else none, root_ids if root_ids is not None else none
    s = rules.select(key, "rule_no", rc.alias("__rc"), ri.alias("__ri"), F.posexplode("selectors").alias("__p", "__s"))
    comp, sub = F.col("__s.compounds"), F.element_at("__s.compounds", -1)
    names = lambda c: F.concat(c["classes"], c["ids"])
    isin = lambda c, values: F.coalesce(c.isin(*values), F.lit(False))
    own = F.size(names(sub)) > 0
    only_root = (sub["tag"].isNull() | isin(sub["tag"], ROOT_TAGS)) & own & (F.size(F.array_except(sub["classes"], F.coalesce("__rc", none))) == 0) & (F.size(F.array_except(sub["ids"], F.coalesce("__ri", none))) == 0)
    return s.select(
        key, "rule_no", (F.col("__p") + 1).alias("selector_no"), F.col("__s.text").alias("selector"), sub.alias("subject"),
        F.exists(comp, lambda c: isin(c["tag"], VECTOR_TAGS) | isin(c["namespace"], VECTOR_NAMESPACES)).alias("vector"),
        (F.exists(sub["pseudo_elements"], lambda p: p.isin(*DROP_CAP_ELEMENTS)) | F.exists(names(sub), lambda n: n.rlike(DROP_CAP_NAME))).alias("drop_cap"),
        ((F.size(sub["pseudo_elements"]) == 0) & (isin(sub["tag"], ROOT_TAGS) | F.array_contains(sub["pseudo_classes"], "root") | only_root)).alias("root"),
        isin(sub["tag"], HEADING_TAGS).alias("heading"),
        F.exists(comp, lambda c: isin(c["tag"], IMAGE_TAGS) | F.exists(names(c), lambda n: n.rlike(IMAGE_NAME))).alias("image"),
    )


FLAGS = ["vector", "drop_cap", "root", "heading", "image"]


def context_groups(selectors: DataFrame, key: str) -> DataFrame:
    """Selectors of a rule that share a context, groups in order of first appearance: key, rule_no, group_no, flags, selectors (joined by ', ')."""
    from pyspark.sql import Window

    g = selectors.groupBy(key, "rule_no", *FLAGS).agg(F.min("selector_no").alias("__first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("selector_no", "selector"))), lambda x: x["selector"]), ", ").alias("selectors"))
    return g.withColumn("group_no", F.row_number().over(Window.partitionBy(key, "rule_no").orderBy("__first"))).drop("__first")


def rule_weights(selectors: DataFrame, census: DataFrame, key: str) -> DataFrame:
    """key, rule_no, weight: how many elements a rule's subjects address, vector, drop-cap, root and pseudo-element selectors aside.

    ``census``: key, tag, classes (array), element_id, n. A subject with a tag, a class or an id meets the census by equality on one of them, the id
    first; only a bare subject meets every entry of its key.
    """
    s = selectors.where(~F.col("vector") & ~F.col("drop_cap") & ~F.col("root") & (F.size("subject.pseudo_elements") == 0))
    handle = F.coalesce(F.concat(F.lit("#"), F.get("subject.ids", F.lit(0))), F.concat(F.lit("."), F.get("subject.classes", F.lit(0))), F.col("subject.tag"), F.lit("*"))
    s = s.select(F.col(key).alias("__k"), "rule_no", "selector_no", "subject", handle.alias("__h"))
    handles = F.concat(F.array(F.lit("*"), F.col("tag")), F.transform("classes", lambda c: F.concat(F.lit("."), c)), F.when(F.col("element_id").isNotNull(), F.array(F.concat(F.lit("#"), "element_id"))).otherwise(F.array().cast("array<string>")))
    c = census.select(key, "tag", "classes", "element_id", "n", F.explode(F.array_distinct(handles)).alias("__h"))
    hit = s.join(c, (F.col("__k") == F.col(key)) & (s["__h"] == c["__h"]))
    fits = (F.col("subject.tag").isNull() | (F.col("subject.tag") == F.col("tag"))) & (F.size(F.array_except("subject.classes", "classes")) == 0) & F.forall("subject.ids", lambda i: i.eqNullSafe(F.col("element_id")))
    weights = hit.where(fits).groupBy(key, "rule_no").agg(F.sum("n").alias("weight"))
    every = selectors.select(key, "rule_no").distinct()
    return every.join(weights, [key, "rule_no"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)).cast("bigint"))


# ---- values ----

_TOKEN = r"\"[^\"]*\"|'[^']*'|[\w-]+\((?:[^()]++|\([^()]*\))*+\)|#[\w-]+|[,/]|[^\s,/\"'()]+"
_LENGTH = r"^([+-]?(?:\d+\.?\d*|\.\d+))(px|pt|pc|in|cm|mm|q)$"


def tokens(value: Column) -> Column:
    """The significant tokens of a value: words, numbers, strings, functions, commas and slashes."""
    return F.regexp_extract_all(value, F.lit(_TOKEN), F.lit(0))


def family_names(value: Column) -> Column:
    """The families of a font list, lower case, quotes away, inner blanks single; empty ones fall away."""
    bare = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), r"\s+", " ")
    return F.filter(F.transform(F.regexp_extract_all(F.lower(value), F.lit(r"(?:\"[^\"]*\"|'[^']*'|[^,\"'])++"), F.lit(0)), bare), lambda x: x != "")


def is_monospace(value: Column) -> Column:
    return F.arrays_overlap(family_names(value), F.array(*[F.lit(m) for m in MONOSPACE]))


def has_absolute_length(value: Column) -> Column:
    return F.exists(tokens(F.lower(value)), lambda t: t.rlike(_LENGTH))


def is_viewport_length(value: Column) -> Column:
    return F.exists(tokens(F.lower(value)), lambda t: t.rlike(rf"^[+-]?(?:\d+\.?\d*|\.\d+)(?:{VIEWPORT_UNITS})$"))


def font_size(value: Column) -> Column:
    """struct(value, unit) of a size that is one dimension or percentage; null for words, functions and several tokens."""
    t = F.lower(F.get(tokens(value), F.lit(0)))
    pattern = r"^([+-]?(?:\d+\.?\d*|\.\d+))([a-z]+|%)$"
    number = F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).try_cast("double")
    return F.when((F.size(tokens(value)) == 1) & number.isNotNull(), F.struct(number.alias("value"), F.regexp_extract(t, pattern, 2).alias("unit")))


def same_size(a: Column, b: Column) -> Column:
    """Whether two sizes are one: both absolute and less than 0.01 px apart, else one unit and the same number."""
    pa, pb = S.pixels(a["value"], a["unit"]), S.pixels(b["value"], b["unit"])
    return F.when(pa.isNotNull() & pb.isNotNull(), F.abs(pa - pb) < 0.01).otherwise((a["unit"] == b["unit"]) & (F.abs(a["value"] - b["value"]) < 1e-6))


def converted(value: Column, base_px: float = 16.0) -> Column:
    """The value with its absolute lengths in em."""
    number, unit = (lambda t: F.regexp_extract(F.lower(t), _LENGTH, 1).try_cast("double")), (lambda t: F.regexp_extract(F.lower(t), _LENGTH, 2))
    em = lambda t: F.when(F.lower(t).rlike(_LENGTH), S.to_em(number(t), unit(t), base_px)).otherwise(t)
    return F.replace(F.array_join(F.transform(tokens(value), em), " "), F.lit(" ,"), F.lit(","))


def without_colours(value: Column, drop_images: Column) -> Column:
    """The tokens of a shorthand without colours and gradients, and without images where asked; commas and slashes at its ends go too."""
    t = lambda x: F.lower(x)
    colour = lambda x: t(x).rlike(r"^#(?:[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$|^(?:rgba?|hsla?|hwb|lab|lch|oklab|oklch)\(") | t(x).isin(*COLOUR_NAMES) | t(x).rlike(r"^(?:-webkit-|-moz-)?(?:repeating-)?(?:linear-|radial-|conic-)?gradient\(")
    kept = F.filter(tokens(value), lambda x: ~colour(x) & ~(drop_images & t(x).startswith("url(")))
    mark = F.array(F.lit(","), F.lit("/"))
    # Strip separators from both ends: what is left stands between the first and the last other token.
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(kept), F.lit(1))), lambda i: ~F.coalesce(F.array_contains(mark, F.try_element_at(kept, i)), F.lit(False)) & (i <= F.size(kept)))
    return F.when(F.size(places) > 0, F.slice(kept, F.get(places, F.lit(0)), F.element_at(places, -1) - F.get(places, F.lit(0)) + 1)).otherwise(F.array().cast("array<string>"))


def font_longhands(value: Column) -> Column:
    """What a font shorthand sets, as a map: style, variant, weight, size, line height, and the family where it is a monospace one; null where the
    shorthand cannot be read: nothing, a system word, no size or no family."""
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)"
    size = rf"(?:{number}(?:[a-z]+|%)|0|{'|'.join(SIZE_WORDS)})"
    lead = rf"(?:(?:normal|italic|oblique|small-caps|bold|bolder|lighter|[1-9]\d{{0,2}}|1000|{'|'.join(STRETCH_WORDS)})\s+)*+"
    pattern = rf"^({lead})({size})(?:\s*/\s*([^\s,]+))?(?=[\s\"'])\s*(\S.*)$"
    v = F.lower(F.trim(value))
    part = lambda i: F.regexp_extract(v, pattern, i)
    last = lambda words: F.regexp_extract(part(1), rf"(?:^|.*\s)({words})\s", 1)
    word = lambda words: F.coalesce(F.nullif(last(words), F.lit("")), F.lit("normal"))
    entries = [("font-style", word("italic|oblique")), ("font-variant", word("small-caps")), ("font-weight", word(r"bold|bolder|lighter|[1-9]\d{0,2}|1000")), ("font-size", part(2)), ("line-height", F.coalesce(F.nullif(part(3), F.lit("")), F.lit("normal")))]
    made = [F.struct(F.lit(k).alias("k"), x.alias("v")) for k, x in entries]
    mono = F.when(is_monospace(part(4)), F.struct(F.lit("font-family").alias("k"), F.lit("monospace").alias("v")))
    return F.when(v.rlike(pattern) & ~v.isin(*SYSTEM_WORDS), F.map_from_entries(F.filter(F.array(*made, mono), lambda e: e.isNotNull())))


# ---- decisions ----


def declaration_decisions(rows: DataFrame, groups: list[str], base_px: float = 16.0, base: Column | None = None) -> DataFrame:
    """Add ``decision`` (drop, keep, convert, expand) and ``new_value`` to declarations (property, value, and the context flags): the first step that applies.

    Vector rules stay whole. Drop caps lose everything but their meaning, or only colours. Then font shorthands are expanded, and colours, their
    shorthands, background images, families, sizes, spacing and the like, root layout, fixed sizes and margins are decided, in this order.
    ``groups`` are the rule groups that run, ``base`` the size of the body text.
    """
    on = {g: F.lit(g in groups) for g in GROUPS}
    c, value = F.col, F.col("value")
    name, no = F.lower("property"), F.lit(False)
    # What many steps ask of a value is worked out once a row, and once for equal declarations in equal contexts.
    keys = ["property", "value", "vector", "drop_cap", "root", "heading", "image"]
    own = rows.select(*keys).distinct().withColumns({"__t": tokens(value), "__l": F.lower(value)})
    lowered = F.transform("__t", lambda t: F.lower(t))
    background = c("root") & (name == "background")
    own = own.withColumns({"__kept": F.when(on["colours"] & name.isin(*COLOUR_SHORTHANDS), without_colours(value, background)), "__abs": F.exists(lowered, lambda t: t.rlike(_LENGTH)), "__long": F.when(on["fonts"] & (name == "font"), font_longhands(value)), "__mono": F.when(name == "font-family", is_monospace(value))})
    kept, absolute = c("__kept"), c("__abs")
    gradient, image = F.exists(lowered, lambda t: t.rlike(r"gradient\(")), F.exists(lowered, lambda t: t.startswith("url("))
    word = F.lower(F.get("__t", F.lit(0)))
    shorthand = on["colours"] & name.isin(*COLOUR_SHORTHANDS)
    same = F.coalesce(same_size(font_size(value), base), no) if base is not None else no
    colour = F.when(on["colours"] & name.isin(*COLOUR_PROPERTIES), "drop").when(shorthand, F.when(F.size(kept) == 0, "drop").when(F.size(kept) < F.size("__t"), "convert").otherwise("keep"))
    sized = on["sizes"] & (name == "font-size")
    decision = (
        F.when(c("vector"), "keep")
        .when(c("drop_cap") & on["plain_drop_caps"], F.when(name.isin(*SEMANTIC), "keep").otherwise("drop"))
        .when(c("drop_cap"), F.coalesce(colour, F.lit("keep")))
        .when(on["fonts"] & (name == "font"), F.when(c("__long").isNull(), "drop").otherwise("expand"))
        .when(colour.isNotNull(), colour)
        .when(on["colours"] & (name == "background-image"), F.when(gradient | (c("root") & image), "drop").otherwise("keep"))
        .when(on["fonts"] & (name == "font-family"), F.when(~c("__mono"), "drop").when((word == "monospace") & (F.size("__t") == 1), "keep").otherwise("convert"))
        .when(sized & (c("root") | (on["heading_sizes_only"] & ~c("heading")) | is_viewport_length(value) | same), "drop")
        .when(sized, F.when(absolute, "convert").otherwise("keep"))
        .when(on["spacing"] & name.isin(*SPACING), "drop")
        .when(on["hyphenation"] & name.isin(*HYPHENATION), "drop")
        .when(on["alignment"] & name.isin(*ALIGNMENT) & (F.size("__t") == 1) & word.isin(*BODY_ALIGNMENTS), "drop")
        .when(on["layout"] & c("root") & name.isin(*ROOT_LAYOUT), "drop")
        .when(on["dimensions"] & ~c("image") & name.isin(*FIXED_SIZES) & absolute, "drop")
        .when(on["margins"] & ~c("image") & ~c("root") & name.isin(*[*BOXES, "text-indent"]) & absolute, "convert")
        .otherwise("keep")
    )
    shown = F.replace(F.array_join(kept, " "), F.lit(" ,"), F.lit(","))
    new = F.when(c("decision") != "convert", value).when(shorthand, shown).when(name == "font-family", "monospace").otherwise(converted(value, base_px))
    own = own.withColumn("decision", decision)
    expanded = F.array_join(F.transform(F.map_entries("__long"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    own = own.select(*[c(k).alias(f"__k_{k}") for k in keys], "decision", F.when(c("decision").isin("keep", "convert"), new).when(c("decision") == "expand", expanded).alias("new_value"))
    on_all = [rows[k].eqNullSafe(own[f"__k_{k}"]) for k in keys]
    return rows.join(own, on_all, "left").drop(*[f"__k_{k}" for k in keys])


def at_rule_decisions(rules: DataFrame, groups: list[str], kept_families: Column) -> DataFrame:
    """Add ``decision`` to rules that are no style rules: a font face goes unless its family is kept; a page loses its margins, and goes where nothing
    else is left; all others stay."""
    families = F.flatten(F.transform(F.filter("declarations", lambda d: d["property"] == "font-family"), lambda d: family_names(d["value"])))
    rest = F.filter("declarations", lambda d: ~d["property"].isin(*PAGE_MARGINS))
    face = F.when(F.coalesce(F.arrays_overlap(families, kept_families), F.lit(False)), "keep").otherwise("drop")
    page = F.when(F.size(rest) == F.size("declarations"), "keep").when(F.size(rest) == 0, "drop").otherwise("convert")
    return rules.where("at_rule IS NOT NULL").withColumn("decision", F.when((F.col("at_rule") == "font-face") & F.lit("fonts" in groups), face).when((F.col("at_rule") == "page") & F.lit("layout" in groups), page).otherwise("keep"))


def kept_families(rules: DataFrame, selectors: DataFrame, key: str, plain_drop_caps: bool) -> DataFrame:
    """key, family: families that vector rules set, and drop-cap rules unless drop caps are made plain; of font shorthands too."""
    exempt = selectors.where(F.col("vector") | (F.col("drop_cap") & F.lit(not plain_drop_caps))).select(key, "rule_no").distinct()
    d = rules.join(exempt, [key, "rule_no"]).select(key, F.explode("declarations").alias("d"))
    size = rf"(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:[a-z]+|%)|{'|'.join(SIZE_WORDS)})"
    behind = F.regexp_extract(F.lower("d.value"), rf"(?:^|\s){size}(?:\s*/\s*[^\s,]+)?(?=[\s\"'])\s*(\S.*)$", 1)
    listed = F.when(F.col("d.property") == "font-family", family_names(F.col("d.value"))).when((F.col("d.property") == "font") & font_longhands(F.col("d.value")).isNotNull(), family_names(behind))
    return d.select(key, F.explode(listed).alias("family")).distinct()


# ---- attributes and members ----

# Elements by what they may lose.
EMBEDDED = ["img", "image", "picture", "source", "object", "embed", "svg", "math", "video", "audio", "canvas", "iframe", "input"]
FONT_TAGS = ["font", "basefont"]
CELLS = ["table", "td", "th", "tr"]
ALIGNED = ["p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "li", "caption", "thead", "tbody", "tfoot", "col", "colgroup"]
SIZED = ["table", "td", "th", "tr", "col", "colgroup", "caption", "thead", "tbody", "tfoot"]


def attribute_removed(tag: Column, name: Column, value: Column, groups: list[str]) -> Column:
    """Whether a presentational attribute goes. Images and other embedded elements keep all of theirs; alignment goes where it is the usual one, sizes
    where they are fixed."""
    on = lambda g: F.lit(g in groups)
    v = F.lower(F.trim(F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", "")))
    hit = (
        (on("colours") & ((name == "bgcolor") | ((name == "color") & tag.isin(*FONT_TAGS)) | (name.isin("text", "link", "vlink", "alink", "background") & (tag == "body")) | (name.isin("background", "bordercolor") & tag.isin(*CELLS))))
        | (on("fonts") & (name == "face") & tag.isin(*FONT_TAGS))
        | (on("alignment") & (name == "align") & tag.isin(*ALIGNED) & v.isin("justify", "left"))
        | (on("dimensions") & name.isin("width", "height") & tag.isin(*SIZED) & v.rlike(r"^\d+(?:\.\d+)?\s*(?:px)?$"))
        | (on("layout") & name.isin("leftmargin", "topmargin", "rightmargin", "bottommargin", "marginwidth", "marginheight") & (tag == "body"))
        | (on("heading_sizes_only") & (name == "size") & tag.isin(*FONT_TAGS))
    )
    return F.coalesce(hit, F.lit(False)) & ~F.coalesce(tag.isin(*EMBEDDED), F.lit(False))


def attribute_rows(tags: DataFrame, key: str) -> DataFrame:
    """One row per attribute of start tags (key, tag_pos, tag, attrs): key, tag_pos, tag, attr_no, name, value; a bare attribute has a null value, and of a
    repeated name the last one counts."""
    pattern = r"([^\s=\"'<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?"
    found = F.regexp_extract_all("attrs", F.lit(pattern), F.lit(0))
    rows = tags.select(key, "tag_pos", "tag", F.posexplode_outer(found).alias("__p", "__t")).where("__t IS NOT NULL")
    rows = rows.select(key, "tag_pos", "tag", (F.col("__p") + 1).alias("attr_no"), F.lower(F.regexp_extract("__t", pattern, 1)).alias("name"), F.when(F.contains("__t", F.lit("=")), F.regexp_replace(F.regexp_extract("__t", pattern, 2), "^[\"']|[\"']$", "")).alias("value"))
    last = rows.groupBy(key, "tag_pos", "name").agg(F.max_by(F.struct("tag", "attr_no", "value"), "attr_no").alias("b"))
    return last.select(key, "tag_pos", "b.tag", "b.attr_no", "name", "b.value")


def member_kind(media_type: Column, href: Column) -> Column:
    """'xhtml', 'css', 'svg', 'font' or 'other', by media type, else by file ending."""
    t, h = F.lower(F.coalesce(media_type, F.lit(""))), F.lower(F.regexp_replace(F.coalesce(href, F.lit("")), "[?#].*$", ""))
    return (
        F.when(t.isin("application/xhtml+xml", "text/html") | ((t == "") & h.rlike(r"\.(?:x?html?)$")), "xhtml")
        .when((t == "text/css") | ((t == "") & h.endswith(".css")), "css")
        .when((t == "image/svg+xml") | ((t == "") & h.endswith(".svg")), "svg")
        .when(t.rlike("^font/|^application/(?:font-|vnd.ms-opentype|x-font-)") | h.rlike(r"\.(?:eot|otf|ttc|ttf|woff2?)$"), "font")
        .otherwise("other")
    )


def without_viewport(text: Column) -> tuple[Column, Column]:
    """(text, n): the text without viewport meta elements and page template links, and how many went."""
    gone = r"(?i)<meta\b(?=[^<>]*\bname\s*=\s*[\"']?viewport\b)[^<>]*>|<link\b(?=[^<>]*\btype\s*=\s*[\"']?application/(?:vnd\.)?adobe(?:\.|-)page-template\+xml)[^<>]*>"
    return F.regexp_replace(text, gone, ""), F.regexp_count(text, F.lit(gone))
