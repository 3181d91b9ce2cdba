"""Cell normalisation and comparison as column expressions; nothing here leaves the JVM.

A *cell* is ``struct<name, kind, text>``: ``kind`` is one of ``null bool num str other`` and
``text`` is the canonical text of the value (numbers keep the decimal places they carry).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = "struct<name:string,kind:string,text:string>"
CELLS = f"array<{CELL}>"

# Default tolerances of the comparison.
ABS_TOL = 1e-6
REL_TOL = 1e-9

# Typographic characters and the ASCII character each one counts as
# (curly single quotes, curly double quotes, en and em dash, no-break space).
PUNCTUATION_FROM = "‘’“”–— "
PUNCTUATION_TO = "''\"\"-- "

NOT_ASCII = r"[^\x00-\x7F]"
ASCII_BLANKS = r"[\s\x1c-\x1f]+"
BLANKS = r"(?U)[\s\x1c-\x1f]+"
MIDNIGHT = r"^(\d{4}-\d{2}-\d{2})[T ]00:00:00(?:\.0+)?$"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
NOT_A_NUMBER = r"(?i)^[+-]?(?:inf(?:inity)?|s?nan\d*)$"


def null_like(c: Column, dtype: T.DataType) -> Column:
    """NULL, NaN and infinities count as missing; containers never do."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        return c.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return c.isNull()


def compose(c: Column) -> Column:
    """NFKC form of text."""
    return F.call_function(
        "reflect",
        F.lit("com.ibm.icu.text.Normalizer"),
        F.lit("compose"),
        c,
        F.lit(True),
    )


def normalize_text(c: Column) -> Column:
    """NFKC, ASCII punctuation, single blanks; plain ASCII text takes the short way."""
    special = F.translate(compose(c), PUNCTUATION_FROM, PUNCTUATION_TO)
    short = F.regexp_replace(c, ASCII_BLANKS, " ")
    return F.trim(
        F.when(c.rlike(NOT_ASCII), F.regexp_replace(special, BLANKS, " ")).otherwise(short)
    )


def midnight_to_date(c: Column) -> Column:
    return F.when(c.contains("00:00:00"), F.regexp_replace(c, MIDNIGHT, "$1")).otherwise(c)


def float_text(c: Column) -> Column:
    """Shortest text of a double, written out in full between 1e-4 and 1e16."""
    d = c.cast("double")
    short = d.cast("string")
    wide = F.rtrim(d.cast("decimal(38,18)").cast("string"), F.lit("0"))
    wide = F.when(wide.endswith("."), F.concat(wide, F.lit("0"))).otherwise(wide)
    small = F.rtrim(d.cast("decimal(38,30)").cast("string"), F.lit("0"))
    size = F.abs(d)
    return (
        F.when(~short.contains("E"), short)
        .when((size >= 1e7) & (size < 1e16), wide)
        .when((size >= 1e-4) & (size < 1e-3), small)
        .otherwise(short)
    )


def timestamp_text(c: Column) -> Column:
    seconds = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return midnight_to_date(
        F.when(micros == "000000", seconds).otherwise(F.concat_ws(".", seconds, micros))
    )


def cell_text(c: Column, dtype: T.DataType) -> tuple[str, Column]:
    """(kind, canonical text) of a typed column; the text is NULL for a missing value."""
    if isinstance(dtype, T.BooleanType):
        return "bool", c.cast("string")
    if isinstance(dtype, T.IntegralType):
        return "num", c.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "num", F.when(~null_like(c, dtype), float_text(c))
    if isinstance(dtype, T.DecimalType):
        return "num", c.cast("string")
    if isinstance(dtype, T.DateType):
        return "str", c.cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "str", timestamp_text(c)
    if isinstance(dtype, T.BinaryType):
        return "str", F.call_function("make_valid_utf8", c.cast("string"))
    if isinstance(dtype, T.StringType):
        return "str", midnight_to_date(normalize_text(c))
    return "other", F.to_json(c, {"ignoreNullFields": "false"})


def make_cell(name: Column, kind: Column, text: Column) -> Column:
    return F.struct(
        name.alias("name"),
        F.when(text.isNull(), F.lit("null")).otherwise(kind).alias("kind"),
        text.alias("text"),
    )


def cell(c: Column, dtype: T.DataType, name: str) -> Column:
    kind, text = cell_text(c, dtype)
    return make_cell(F.lit(name), F.lit(kind), text)


def cells_of(df: DataFrame, columns: Sequence[str]) -> Column:
    """The row's cells in column order."""
    return F.array(*[cell(F.col(c), df.schema[c].dataType, c) for c in columns])


# ---------------------------------------------------------------- numbers


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where no code is generated."""
    return F.transform(F.array(value), body)[0]


def number_text(text: Column) -> Column:
    """The text as a plain or exponent number, NULL when it is none."""
    bare = F.replace(F.trim(text), F.lit("_"), F.lit(""))
    return let(bare, lambda b: F.when(b.rlike(NUMBER), b))


def try_number(kind: Column, text: Column) -> Column:
    """DECIMAL value of a number or numeric text; booleans and the rest are NULL."""
    return F.when(kind.isin("num", "str"), number_text(text).try_cast("decimal(38,18)"))


def _exponent(number: Column) -> Column:
    return F.regexp_extract(number, r"[eE]([+-]?\d+)$", 1).try_cast("int")


#: Digits before the point, and zeros after it, up to which a token has the number written out.
WRITTEN_OUT = 40


def _normal_token(number: Column) -> Column:
    """``number_token`` of a number with an exponent or many digits, from its sign, stripped digits and power of ten."""
    mantissa = F.regexp_extract(number, r"^[+-]?([0-9.]+)", 1)
    fraction = F.when(mantissa.contains("."), F.length(F.substring_index(mantissa, ".", -1))).otherwise(0)
    power = F.coalesce(F.regexp_extract(number, r"[eE]([+-]?\d+)$", 1).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    parts = F.struct(
        F.when(number.startswith("-"), "-").otherwise("").alias("sign"),
        F.regexp_replace(F.replace(mantissa, F.lit(".")), "^0+", "").alias("digits"),
        (power - fraction).cast("decimal(38,0)").alias("power"),
    )

    def stripped(p: Column) -> Column:
        short = F.regexp_replace(p["digits"], "0+$", "")
        moved = (p["power"] + F.length(p["digits"]) - F.length(short)).cast("decimal(38,0)")
        return F.struct(p["sign"].alias("sign"), short.alias("digits"), moved.alias("power"))

    def written(p: Column) -> Column:
        digits, size = p["digits"], F.length(p["digits"])
        point = size + p["power"]
        near = F.least(F.greatest(point, F.lit(-WRITTEN_OUT)), F.lit(WRITTEN_OUT)).cast("int")
        plain = (
            F.when(near <= 0, F.concat(F.lit("."), F.repeat(F.lit("0"), -near), digits))
            .when(near >= size, F.concat(digits, F.repeat(F.lit("0"), near - size), F.lit(".")))
            .otherwise(F.concat(F.substring(digits, F.lit(1), near), F.lit("."), F.substring(digits, near + 1, size)))
        )
        token = F.when(F.abs(point) <= WRITTEN_OUT, plain).otherwise(F.concat(digits, F.lit("E"), p["power"].cast("string")))
        return F.concat(p["sign"], F.when(size == 0, ".").otherwise(token))

    return let(parts, lambda p: let(stripped(p), written))


def decimal_places(number: Column) -> Column:
    """Places after the point that the number's own text carries, 0 for integers."""
    fraction = F.length(F.substring_index(number, ".", -1))
    mantissa = F.regexp_extract(number, r"\.(\d*)[eE]", 1)
    scaled = F.when(mantissa == "0", 0).otherwise(F.length(mantissa)) - _exponent(number)
    return (
        F.when(number.isNull(), F.lit(None).cast("int"))
        .when(number.contains("E") | number.contains("e"), F.greatest(scaled, F.lit(0)))
        .when(number.contains("."), fraction)
        .otherwise(0)
    )


def number_token(number: Column) -> Column:
    """One text per value, exact at any size: sign, digits, point, digits, without outer zeros.

    A number of more than ``WRITTEN_OUT`` digits before the point, or zeros after it, has digits and power of ten instead.
    """
    odd = number.contains("E") | number.contains("e") | (F.length(number) > WRITTEN_OUT)
    plain = F.regexp_replace(number, r"^\+?(-?)0*(\d*)(?:\.(\d*?)0*)?$", "$1$2.$3")
    return F.when(odd, _normal_token(number)).otherwise(plain)


def _float_token(text: Column) -> Column:
    """``number_token`` of the text of a double: only its shape ``[-]d.d`` has to be trimmed."""
    whole = F.substring_index(text, ".", 1)
    bare = F.when(whole == "0", "").when(whole == "-0", "-").otherwise(whole)
    return F.when(text.contains("E"), number_token(text)).otherwise(
        F.concat(
            bare,
            F.lit("."),
            F.when(text.endswith(".0"), "").otherwise(F.substring_index(text, ".", -1)),
        )
    )


def _decimal_token(text: Column, scale: int) -> Column:
    """``number_token`` of the text of a decimal column: most have the shape ``[-]d.d`` and only zeros to trim."""
    whole = F.substring_index(text, ".", 1)
    bare = F.when(whole == "0", "").when(whole == "-0", "-").otherwise(whole)
    fraction = F.rtrim(F.substring_index(text, ".", -1), F.lit("0")) if scale > 0 else F.lit("")
    odd = text.contains("E") | (F.length(text) > WRITTEN_OUT)
    return F.when(odd, number_token(text)).otherwise(F.concat(bare, F.lit("."), fraction))


def _token(kind: Column, text: Column, number: Column) -> Column:
    lowered = F.lower(F.trim(text))
    return (
        F.when(kind == "null", F.lit("null"))
        .when(kind == "bool", F.concat(F.lit("bool:"), text))
        .when(number.isNotNull(), F.concat(F.lit("num:"), number_token(number)))
        .when(
            (kind != "other")
            & F.substring(lowered, 1, 1).isin("+", "-", "i", "n", "s")
            & text.rlike(NOT_A_NUMBER),
            F.concat(F.lit("num:"), lowered),
        )
        .otherwise(F.concat(F.lit("str:"), lowered))
    )


def token(kind: Column, text: Column) -> Column:
    """Canonical, name-free token of a cell: equal tokens mean equal cells."""
    number = F.when(kind.isin("num", "str"), number_text(text))
    return let(number, lambda n: _token(kind, text, n))


def cell_token(c: Column) -> Column:
    return token(c["kind"], c["text"])


def _fields(c: Column, number: Column) -> Column:
    return F.struct(
        c["kind"].alias("kind"),
        c["text"].alias("text"),
        F.lower(F.trim(c["text"])).alias("low"),
        _token(c["kind"], c["text"], number).alias("tok"),
        number.try_cast("decimal(38,18)").alias("num"),
        number.try_cast("double").alias("dbl"),
        decimal_places(number).alias("places"),
    )


def prepare(cells: Column) -> Column:
    """Parse each cell once: kind, text, lowered text, token, number (exact and double), places.

    Names are left out, so two prepared rows compare by value alone.
    """

    def one(c: Column) -> Column:
        number = F.when(c["kind"].isin("num", "str"), number_text(c["text"]))
        return let(number, lambda n: _fields(c, n))

    return F.transform(cells, one)


def prepare_again(cells: Column, places: Column) -> Column:
    """The prepared cells of a row of which only the cells and the places were kept; a cell without places is no number.

    Bytes that spell nan or inf get the token that text has; they are equal to the same cells either way.
    """
    one = lambda c, k: let(F.when(k.isNotNull(), number_text(c["text"])), lambda n: _fields(c, n))
    return F.zip_with(cells, places, one)


def prepared_columns(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Column, Column]:
    """(frame with text columns, cells, prepared cells) of typed columns.

    The types are known when the plan is built, so no lambda is needed: texts are plain columns
    of one projection and everything runs as generated code.
    """
    texts = {}
    for i, c in enumerate(columns):
        kind, text = cell_text(F.col(f"`{c}`"), df.schema[c].dataType)
        texts[c] = (kind, f"_text_{i}", text)
    out = df.select("*", *[t.alias(n) for _, n, t in texts.values()])
    numbers = {
        c: number_text(F.col(n)).alias(f"{n}_n")
        for c, (kind, n, _) in texts.items()
        if kind == "str" and isinstance(df.schema[c].dataType, T.StringType)
    }
    out = out.select("*", *numbers.values())
    cells, prepared = [], []
    for c, (kind, n, _) in texts.items():
        text, dtype = F.col(n), df.schema[c].dataType
        shown = F.when(text.isNull(), F.lit("null")).otherwise(F.lit(kind))
        cells.append(F.struct(F.lit(c).alias("name"), shown.alias("kind"), text.alias("text")))
        low = F.lower(F.trim(text)) if kind in ("str", "other") else text
        nothing = lambda typ: F.lit(None).cast(typ)
        if isinstance(dtype, T.IntegralType):
            digits = F.when(F.col(c) == 0, F.lit("")).otherwise(text)
            tok = F.concat(F.lit("num:"), digits, F.lit("."))
            exact, double, places = F.col(c).cast("decimal(38,18)"), F.col(c).cast("double"), F.lit(0)
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            tok = F.concat(F.lit("num:"), _float_token(text))
            double = F.when(text.isNotNull(), F.col(c).cast("double"))
            exact = double.try_cast("decimal(38,18)")
            places = F.when(text.contains("E"), decimal_places(text)).otherwise(
                F.length(text) - F.instr(text, ".")
            )
        elif kind == "num":
            tok = F.concat(F.lit("num:"), _decimal_token(text, dtype.scale))
            exact, double = F.col(f"`{c}`").try_cast("decimal(38,18)"), F.col(f"`{c}`").cast("double")
            places = F.when(text.contains("E"), decimal_places(text)).otherwise(max(dtype.scale, 0))
        elif c in numbers:
            number = F.col(f"{n}_n")
            tok = _token(F.lit("str"), text, number)
            exact, double, places = (
                number.try_cast("decimal(38,18)"), number.try_cast("double"), decimal_places(number)
            )
        else:
            tok = F.concat(F.lit("bool:" if kind == "bool" else "str:"), low)
            exact, double, places = nothing("decimal(38,18)"), nothing("double"), nothing("int")
        prepared.append(
            F.struct(
                shown.alias("kind"),
                text.alias("text"),
                low.alias("low"),
                F.when(text.isNull(), F.lit("null")).otherwise(tok).alias("tok"),
                exact.alias("num"),
                double.alias("dbl"),
                F.when(text.isNotNull(), places).alias("places"),
            )
        )
    return out, F.array(*cells), F.array(*prepared)


def row_signature(prepared: Column) -> Column:
    """Multiset of the row's tokens as text: column names and order do not matter."""
    return F.to_json(F.array_sort(F.transform(prepared, lambda c: c["tok"])))


def round_to_places(value: Column, places: Column) -> Column:
    """Half-even rounding of a DECIMAL(38,18) to a per-row number of places (the builtin wants a constant)."""
    out = F.when(places == 0, F.bround(value, 0).cast("decimal(38,18)"))
    for k in range(1, 18):
        out = out.when(places == k, F.bround(value, k).cast("decimal(38,18)"))
    return out.otherwise(value)


def _fits(c: Column) -> Column:
    """Whether ``num`` of a prepared number holds all its digits."""
    return c["num"].isNotNull() & ~c["tok"].contains("E") & (F.length(F.substring_index(c["tok"], ".", -1)) <= 18)


def _long_equal(gold: Column, pred: Column, abs_tol: Column, rel_tol: Column, far: Column) -> Column:
    """``numeric_equal`` where DECIMAL(38,18) does not hold all digits of both numbers.

    Integers of 38 digits, and small numbers of 36 places, are subtracted exactly. Of others, different values are equal
    only within a tolerance that is not zero, as doubles (``far``).
    """
    text = lambda c: F.substring(c["tok"], F.lit(5), F.length(c["tok"]))
    whole = lambda c: F.when(c["tok"].endswith("."), text(c).try_cast("decimal(38,0)"))
    small = lambda c: F.when(F.length(F.substring_index(c["tok"], ".", -1)) <= 36, text(c).try_cast("decimal(38,36)"))
    size = F.greatest(F.abs(gold["dbl"]), F.abs(pred["dbl"]), F.lit(1.0))
    within = lambda gap: F.abs(gap).cast("double") <= F.greatest(abs_tol, rel_tol * size)
    loose = far & ((abs_tol > 0) | (rel_tol > 0))
    return F.coalesce(within(whole(gold) - whole(pred)), within(small(gold) - small(pred)), loose)


def numeric_equal(gold: Column, pred: Column, abs_tol: Column, rel_tol: Column) -> Column:
    """Compare prepared numbers: ``pred`` is first rounded to the places ``gold`` carries.

    Equal values are equal at any size; see ``_long_equal`` for those that DECIMAL(38,18) does not hold.
    """

    def near(rounded: Column) -> Column:
        size = F.greatest(F.abs(gold["num"]), F.abs(rounded), F.lit(1)).cast("double")
        return F.abs(gold["num"] - rounded).cast("double") <= F.greatest(abs_tol, rel_tol * size)

    far_size = F.greatest(F.abs(gold["dbl"]), F.abs(pred["dbl"]), F.lit(1.0))
    gap = F.abs(gold["dbl"] - pred["dbl"])
    far = gap <= F.greatest(abs_tol, rel_tol * far_size)
    # rounding moves a value by at most one half, so a wider gap needs no exact arithmetic
    apart = (gap > 1.0 + 2 * (abs_tol + rel_tol * far_size)) & (far_size < 1e300)
    exact = let(round_to_places(pred["num"], gold["places"]), near)
    digits = F.when(_fits(gold) & _fits(pred), exact).otherwise(_long_equal(gold, pred, abs_tol, rel_tol, far))
    return F.when(apart | gap.isNull(), F.lit(False)).when(gold["tok"] == pred["tok"], F.lit(True)).otherwise(F.coalesce(digits, F.lit(False)))


def values_equal(gold: Column, pred: Column, abs_tol: Column, rel_tol: Column) -> Column:
    """Equality of two prepared cells with tolerance; never NULL."""
    gk, pk = gold["kind"], pred["kind"]
    bit = lambda c: F.when(c["kind"] == "bool", (c["text"] == "true").cast("double")).otherwise(c["dbl"])
    out = (
        F.when((gk == "num") & (pk == "num") & (gold["tok"] == pred["tok"]), F.lit(True))
        .when((gk == "str") & (pk == "str"), gold["low"] == pred["low"])
        .when((gk == pk) & (gk != "num"), gold["text"].eqNullSafe(pred["text"]))
        .when(gk.isin("null", "other") | pk.isin("null", "other"), F.lit(False))
        .when((gk == "bool") | (pk == "bool"), (gk != "str") & (pk != "str") & (bit(gold) == bit(pred)))
        .otherwise(numeric_equal(gold, pred, abs_tol, rel_tol))
    )
    return F.coalesce(out, F.lit(False))


def cells_equal(gold: Column, pred: Column, abs_tol: Column, rel_tol: Column) -> Column:
    """``values_equal`` of cells that are expressions: each is computed once, however often it is looked at."""
    both = F.struct(gold.alias("g"), pred.alias("p"), abs_tol.alias("a"), rel_tol.alias("r"))
    return let(both, lambda x: values_equal(x["g"], x["p"], x["a"], x["r"]))


def rows_equal(gold: Column, pred: Column, abs_tol: Column, rel_tol: Column) -> Column:
    """Each gold cell takes the first still free pred cell it equals; all must find one.

    Rows whose cells agree place by place always succeed that way, which spares the search.
    """

    def consume(left: Column, g: Column) -> Column:
        at = F.array_position(
            F.transform(left, lambda p: values_equal(g, p, abs_tol, rel_tol)), F.lit(True)
        ).cast("int")
        return let(at, lambda a: F.when(a > 0, F.filter(left, lambda _, i: i != a - 1)))

    in_place = F.forall(
        F.zip_with(gold, pred, lambda g, p: values_equal(g, p, abs_tol, rel_tol)), lambda x: x
    )
    searched = F.aggregate(gold, pred, consume, lambda rest: rest.isNotNull())
    return (
        F.when(F.size(gold) != F.size(pred), F.lit(False))
        .when(in_place, F.lit(True))
        .otherwise(F.coalesce(searched, F.lit(False)))
    )


def canonical_json(df: DataFrame, columns: Sequence[str]) -> Column:
    """Compact JSON of a row with sorted keys; missing values are written as null."""
    clean = []
    for c in sorted(columns):
        value = F.col(c)
        clean.append(F.when(~null_like(value, df.schema[c].dataType), value).alias(c))
    return F.to_json(F.struct(*clean), {"ignoreNullFields": "false"})


def fingerprint(tokens: Callable[[], Column] | Column, weight: Column | int = 1) -> list[Column]:
    """Order-free fingerprint of a multiset of tokens: two sums of independent hashes."""
    t = tokens() if callable(tokens) else tokens
    w = F.lit(weight) if isinstance(weight, int) else weight
    first = F.sum(F.xxhash64(t).cast("decimal(20,0)") * w.cast("decimal(18,0)"))
    second = F.sum(F.xxhash64(F.lit(7), t).cast("decimal(20,0)") * w.cast("decimal(18,0)"))
    return [first, second]
