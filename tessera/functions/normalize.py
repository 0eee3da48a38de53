"""Value normalizers as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import JS_SPACE, built_once, col, has, js_trim, let, part

NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)"

#: The CSS named colours.
NAMED_COLORS = """
aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000
blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887 cadetblue 5f9ea0 chartreuse 7fff00
chocolate d2691e coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b
darkcyan 008b8b darkgoldenrod b8860b darkgray a9a9a9 darkgreen 006400 darkgrey a9a9a9 darkkhaki bdb76b
darkmagenta 8b008b darkolivegreen 556b2f darkorange ff8c00 darkorchid 9932cc darkred 8b0000 darksalmon e9967a
darkseagreen 8fbc8f darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f darkturquoise 00ced1
darkviolet 9400d3 deeppink ff1493 deepskyblue 00bfff dimgray 696969 dimgrey 696969 dodgerblue 1e90ff
firebrick b22222 floralwhite fffaf0 forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff gold ffd700
goldenrod daa520 gray 808080 green 008000 greenyellow adff2f grey 808080 honeydew f0fff0 hotpink ff69b4
indianred cd5c5c indigo 4b0082 ivory fffff0 khaki f0e68c lavender e6e6fa lavenderblush fff0f5 lawngreen 7cfc00
lemonchiffon fffacd lightblue add8e6 lightcoral f08080 lightcyan e0ffff lightgoldenrodyellow fafad2 lightgray d3d3d3
lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1 lightsalmon ffa07a lightseagreen 20b2aa lightskyblue 87cefa
lightslategray 778899 lightslategrey 778899 lightsteelblue b0c4de lightyellow ffffe0 lime 00ff00 limegreen 32cd32
linen faf0e6 magenta ff00ff maroon 800000 mediumaquamarine 66cdaa mediumblue 0000cd mediumorchid ba55d3
mediumpurple 9370db mediumseagreen 3cb371 mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc
mediumvioletred c71585 midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead
navy 000080 oldlace fdf5e6 olive 808000 olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6
palegoldenrod eee8aa palegreen 98fb98 paleturquoise afeeee palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9
peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6 purple 800080 rebeccapurple 663399 red ff0000 rosybrown bc8f8f
royalblue 4169e1 saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57 seashell fff5ee sienna a0522d
silver c0c0c0 skyblue 87ceeb slateblue 6a5acd slategray 708090 slategrey 708090 snow fffafa springgreen 00ff7f
steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8 tomato ff6347 turquoise 40e0d0 violet ee82ee wheat f5deb3
white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32
"""


def _digits(t: Column) -> Column:
    """Sign, whole and fractional digits of a number's text, without idle zeros."""
    digits = F.regexp_replace(t, "^[+-]", "")
    frac = F.regexp_replace(F.when(digits.contains("."), F.split_part(digits, F.lit("."), F.lit(2))).otherwise(""), "0+$", "")
    return F.struct(
        t.alias("text"),
        F.regexp_replace(F.split_part(digits, F.lit("."), F.lit(1)), "^0+", "").alias("whole"),
        frac.alias("frac"),
        F.regexp_replace(frac, "^0+", "").alias("tiny"),
    )


def _printed(d: Column) -> Column:
    whole, frac, tiny = d["whole"], d["frac"], d["tiny"]
    sign = F.when(d["text"].startswith("-") & ((whole != "") | (frac != "")), "-").otherwise("")
    point = lambda x: F.concat(F.substring(x, 1, 1), F.when(F.length(x) > 1, F.concat(F.lit("."), F.substring(x, 2, 1 << 20))).otherwise(""))
    plain = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac)))
    zeros = F.length(frac) - F.length(tiny)
    small = F.concat(point(tiny), F.lit("e-"), (zeros + 1).cast("string"))
    large = F.concat(point(F.regexp_replace(whole, "0+$", "")), F.lit("e+"), (F.length(whole) - 1).cast("string"))
    body = F.when((whole == "") & (zeros >= 6) & (tiny != ""), small).when(F.length(whole) > 21, large).otherwise(plain)
    return F.concat(sign, body)


def format_number(x) -> Column:
    """The shortest decimal text of a plain number; other text only trimmed."""
    return let(js_trim(x), lambda t: F.when(has(t, f"^{NUMBER}$"), let(_digits(t), _printed)).otherwise(t))


def normalize_keyword(x) -> Column:
    return F.lower(js_trim(x))


def normalize_length(x) -> Column:
    """Number and lower-case unit; a number alone is pixels; else null."""
    pattern = f"^({NUMBER})([A-Za-z%]*)$"
    unit = lambda t: F.coalesce(F.nullif(F.lower(part(t, pattern, 2)), F.lit("")), F.lit("px"))
    return let(js_trim(x), lambda t: F.when(has(t, pattern), F.concat(format_number(part(t, pattern)), unit(t))))


@built_once
def normalize_property(x) -> Column:
    """Kebab case; custom properties stay as they are."""
    kebab = lambda t: F.regexp_replace(F.lower(F.regexp_replace(t, "([A-Z])", "-$1")), "^ms-", "-ms-")
    return let(js_trim(x), lambda t: F.when(t.startswith("--"), t).when(~has(t, "[A-Z]"), F.lower(t)).otherwise(kebab(t)))


def normalize_url(x) -> Column:
    t = js_trim(x)
    pattern = r"""(?i)^url\(\s*(['"]?)([^'")]*)\1\s*\)$"""
    return F.when(has(t, pattern), F.concat(F.lit("url("), js_trim(part(t, pattern, 2)), F.lit(")")))


def normalize_shadow(x) -> Column:
    return F.regexp_replace(js_trim(x), f"{JS_SPACE}+", " ")


def normalize_number(x) -> Column:
    t = js_trim(x)
    return F.when(has(t, f"^{NUMBER}$"), format_number(t))


def _channel(x: Column) -> Column:
    """A share of one as two hex digits."""
    return F.lower(F.lpad(F.hex(F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("long")), 2, "0"))


#: What a full percentage of each component stands for.
_FULL = {
    "rgb": (255, 255, 255, 1), "rgba": (255, 255, 255, 1), "hsl": (360, 1, 1, 1), "hsla": (360, 1, 1, 1), "hwb": (360, 1, 1, 1),
    "lab": (100, 125, 125, 1), "lch": (100, 150, 360, 1), "oklab": (1, 0.4, 0.4, 1), "oklch": (1, 0.4, 360, 1),
}


def _component(b: Column, full: Column) -> Column:
    """A component as a number, angles in degrees."""
    n = F.regexp_replace(b, "[a-z%]+$", "").try_cast("double")
    unit = (
        F.when(b.endswith("%"), full / 100)
        .when(b.endswith("grad"), F.lit(0.9))
        .when(b.endswith("rad"), F.lit(180 / math.pi))
        .when(b.endswith("turn"), F.lit(360.0))
        .otherwise(F.lit(1.0))
    )
    return F.when(b == "none", 0.0).otherwise(n * unit)


def _from_hue(h: Column, low: Column, high: Column) -> Column:
    """RGB with the given extremes at hue h."""
    wave = lambda k: F.greatest(F.lit(-1.0), F.least(k - 3, F.lit(9.0) - k, F.lit(1.0)))
    turns = F.array(*[F.pmod(h / 30 + shift, F.lit(12.0)) for shift in (0, 8, 4)])
    return let(F.struct(low.alias("a"), high.alias("b")), lambda x: F.transform(turns, lambda k: (x["b"] + x["a"]) / 2 - (x["b"] - x["a"]) / 2 * wave(k)))


def _gamma(x: Column) -> Column:
    a = F.abs(x)
    return F.when(a <= 0.0031308, x * 12.92).otherwise(F.signum(x) * (1.055 * F.pow(a, F.lit(1 / 2.4)) - 0.055))


def _product(rows, v: Column) -> list[Column]:
    return [p * v[0] + q * v[1] + r * v[2] for p, q, r in rows]


def _from_oklab(v: Column) -> Column:
    to_lms = ((1, 0.3963377773761749, 0.2158037573099136), (1, -0.1055613458156586, -0.0638541728258133), (1, -0.0894841775298119, -1.2914855480194092))
    to_rgb = ((4.0767416360759574, -3.3077115392580616, 0.2309699031821044), (-1.2684379732850317, 2.6097573492876887, -0.3413193760026572), (-0.0041960761386756, -0.7034186179359362, 1.7076146940746117))
    cubes = F.transform(F.array(*_product(to_lms, v)), lambda x: x * x * x)
    return let(cubes, lambda c: F.transform(F.array(*_product(to_rgb, c)), _gamma))


def _from_lab(v: Column) -> Column:
    """Lab under D50 to sRGB."""
    to_rgb = ((3.1341359569958707, -1.6173863321612538, -0.4906619460083532), (-0.978795502912089, 1.916254567259524, 0.03344273116131949), (0.07195537988411677, -0.2289768264158322, 1.405386058324125))
    white = F.array(F.lit(0.3457 / 0.3585), F.lit(1.0), F.lit((1 - 0.3457 - 0.3585) / 0.3585))
    fy = (v[0] + 16) / 116
    bent = F.transform(F.array(fy + v[1] / 500, fy, fy - v[2] / 200), lambda f: F.when(f > 6 / 29, f * f * f).otherwise((f - 16 / 116) * (3 * 36 / 841)))
    xyz = F.zip_with(bent, white, lambda a, w: a * w)
    return let(xyz, lambda c: F.transform(F.array(*_product(to_rgb, c)), _gamma))


def _polar(v: Column) -> Column:
    return F.array(v[0], v[1] * F.cos(F.radians(v[2])), v[1] * F.sin(F.radians(v[2])))


def _function_color(name: Column, v: Column) -> Column:
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    def hsl(x: Column) -> Column:
        spread = x["s"] * F.least(x["l"], 1 - x["l"])
        return _from_hue(v[0], x["l"] - spread, x["l"] + spread)

    def hwb(x: Column) -> Column:
        over = x["s"] + x["l"]
        return _from_hue(v[0], F.when(over >= 1, x["s"] / over).otherwise(x["s"]), F.when(over >= 1, x["s"] / over).otherwise(1 - x["l"]))

    pair = F.struct(clamp(v[1]).alias("s"), clamp(v[2]).alias("l"))
    channels = (
        F.when(name.startswith("rgb"), F.transform(F.slice(v, 1, 3), lambda c: c / 255))
        .when(name.startswith("hsl"), let(pair, hsl))
        .when(name == "hwb", let(pair, hwb))
        .when(name == "lab", _from_lab(v))
        .when(name == "lch", let(_polar(v), _from_lab))
        .when(name == "oklab", _from_oklab(v))
        .otherwise(let(_polar(v), _from_oklab))
    )
    alpha = clamp(F.coalesce(F.get(v, F.lit(3)), F.lit(1.0)))
    return F.concat(F.array_join(F.transform(channels, _channel), ""), F.when(alpha < 1, _channel(alpha)).otherwise(""))


def _parsed_function(t: Column) -> Column:
    """Name and component texts of a colour function."""
    inner = part(t, r"^[a-z]+\(\s*([^()]*?)\s*\)$")
    return F.struct(part(t, r"^([a-z]+)\(").alias("name"), F.split(F.regexp_replace(inner, r"\s*[,/]\s*|\s+", " "), " ").alias("bits"))


def _lookup(pairs) -> Column:
    """A map from two literals, which the optimiser folds to one: plans stay small."""
    keys, values = zip(*pairs)
    return F.map_from_arrays(F.split(F.lit(" ".join(keys)), " "), F.split(F.lit(" ".join(values)), " "))


def _evaluated(f: Column) -> Column:
    number = r"^(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?(?:%|deg|rad|grad|turn)?|none)$"
    table = _lookup([(k, ",".join(str(float(n)) for n in v)) for k, v in _FULL.items()])
    full = F.split(F.try_element_at(table, f["name"]), ",").cast("array<double>")
    sound = F.size(f["bits"]).isin(3, 4) & F.forall(f["bits"], lambda b: b.rlike(number))
    values = F.zip_with(f["bits"], F.slice(full, 1, F.size(f["bits"])), _component)
    # hsl and hwb also take bare numbers for percentages.
    plain = F.transform(values, lambda x, i: F.when(f["name"].rlike("^h") & i.isin(1, 2) & ~F.get(f["bits"], i).endswith("%"), x / 100).otherwise(x))
    return F.when(sound, let(plain, lambda v: F.when(v.isNotNull(), _function_color(f["name"], v))))


def _hex_color(h: Column) -> Column:
    full = F.when(F.length(h).isin(3, 4), F.regexp_replace(h, "(.)", "$1$1")).when(F.length(h).isin(6, 8), h)
    return let(full, lambda x: F.when((F.length(x) == 8) & x.endswith("ff"), F.substring(x, 1, 6)).otherwise(x))


def _color(t: Column) -> Column:
    names = NAMED_COLORS.split()
    table = _lookup(list(zip(names[::2], names[1::2])))
    return F.concat(
        F.lit("#"),
        F.when(has(t, "^#[0-9a-f]{3,8}$"), _hex_color(F.substring(t, 2, 8)))
        .when(has(t, r"^[a-z]+\("), let(_parsed_function(t), _evaluated))
        .when(t == "transparent", "00000000")
        .when(has(t, "^[a-z]+$"), F.try_element_at(table, t)),
    )


@built_once
def normalize_color(x) -> Column:
    """#rrggbb, or #rrggbbaa where alpha is below one; null where it is no colour."""
    return let(F.lower(js_trim(x)), _color)


@built_once
def normalize_value(kind, raw) -> Column:
    """The normal form of a raw value by its type; null where there is none."""
    kind, raw = col(kind), col(raw)
    return (
        F.when(kind == "color", normalize_color(raw))
        .when(kind == "length", normalize_length(raw))
        .when(kind == "number", normalize_number(raw))
        .when(kind == "keyword", normalize_keyword(raw))
        .when(kind == "string", raw)
        .when(kind == "module", js_trim(raw))
        .when(kind == "url", normalize_url(raw))
        .when(kind == "shadow", normalize_shadow(raw))
    )
