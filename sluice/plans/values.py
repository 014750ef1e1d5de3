"""Compiled expressions: a value column, a nullable error column and a type.

``value`` never throws; ``err`` holds the message of what went wrong, or is None
where nothing can. Operators decide whether a row with an error leaves for the
error table (add, select) or fails the whole pipe (filter, map).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PipeError(Exception):
    """What a pipe step reports; becomes ``Err`` at the end of the pipe."""


@dataclass(frozen=True)
class Val:
    col: Column
    kind: T.DataType
    err: Column | None = None
    nullable: bool = True


INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REALS = (T.FloatType, T.DoubleType, T.DecimalType)
LONG, DOUBLE, STRING, BOOL, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()


def is_int(v: Val) -> bool:
    return isinstance(v.kind, (*INTS, T.BooleanType))


def is_real(v: Val) -> bool:
    return isinstance(v.kind, REALS)


def is_number(v: Val) -> bool:
    return is_int(v) or is_real(v)


def is_text(v: Val) -> bool:
    return isinstance(v.kind, T.StringType)


def is_null(v: Val) -> bool:
    return isinstance(v.kind, T.NullType)


def is_list(v: Val) -> bool:
    return isinstance(v.kind, T.ArrayType)


def kind_name(v: Val) -> str:
    return v.kind.simpleString()


def errs(*parts: Column | None) -> Column | None:
    real = [p for p in parts if p is not None]
    return None if not real else real[0] if len(real) == 1 else F.coalesce(*real)


def when_err(condition: Column, message: str) -> Column:
    return F.when(condition, F.lit(message))


def failing(message: str, kind: T.DataType = NULL) -> Val:
    return Val(F.lit(None).cast(kind), kind, F.lit(message))


def literal(value) -> Val:
    if value is None:
        return Val(F.lit(None), NULL)
    if isinstance(value, bool):
        return Val(F.lit(value), BOOL, nullable=False)
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            return failing("whole number beyond 64 bits", LONG)
        return Val(F.lit(value).cast("bigint"), LONG, nullable=False)
    if isinstance(value, float):
        return Val(F.lit(value), DOUBLE, nullable=False)
    if isinstance(value, str):
        return Val(F.lit(value), STRING, nullable=False)
    if isinstance(value, (list, tuple, range)):
        return array([literal(x) for x in value])
    if isinstance(value, dict):
        return struct({k: literal(x) for k, x in value.items()})
    raise PipeError(f"{type(value).__name__} has no place in a row")


def joint_kind(kinds: list[T.DataType]) -> T.DataType:
    real = [k for k in kinds if not isinstance(k, T.NullType)]
    if not real:
        return NULL
    if all(k == real[0] for k in real):
        return real[0]
    if all(isinstance(k, (*INTS, *REALS)) for k in real):
        return LONG if all(isinstance(k, INTS) for k in real) else DOUBLE
    if all(isinstance(k, T.ArrayType) for k in real):
        return T.ArrayType(joint_kind([k.elementType for k in real]))
    if all(isinstance(k, T.StructType) and k.names == real[0].names for k in real):
        return T.StructType([T.StructField(n, joint_kind([k[n].dataType for k in real])) for n in real[0].names])
    raise PipeError("values of different types in one place: " + ", ".join(sorted({k.simpleString() for k in real})))


def array(items: list[Val]) -> Val:
    if not items:
        return Val(F.array().cast("array<string>"), T.ArrayType(STRING), nullable=False)
    kind = joint_kind([i.kind for i in items])
    return Val(F.array(*[i.col.cast(kind) for i in items]), T.ArrayType(kind), errs(*[i.err for i in items]), False)


def struct(fields: dict[str, Val]) -> Val:
    kind = T.StructType([T.StructField(n, v.kind) for n, v in fields.items()])
    return Val(F.struct(*[v.col.alias(n) for n, v in fields.items()]), kind, errs(*[v.err for v in fields.values()]), False)


def number(v: Val) -> Column:
    return v.col.cast("bigint") if is_int(v) else v.col.cast("double")


def truthy(v: Val) -> Column:
    """Null, zero, and empty strings and lists are false; NaN is true."""
    if is_null(v):
        return F.lit(False)
    if isinstance(v.kind, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if is_number(v):
        return F.coalesce(v.col != 0, F.lit(False))
    if is_text(v):
        return F.coalesce(v.col != "", F.lit(False))
    if is_list(v):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return v.col.isNotNull()


def _missing(op: str, *vals: Val) -> Column | None:
    """Error of an operator that none of these values may be null in."""
    null = [v.col.isNull() for v in vals if v.nullable]
    if not null:
        return None
    any_null = null[0] if len(null) == 1 else null[0] | null[1]
    return when_err(any_null, f"unsupported operand for {op}: none")


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if is_null(a) or is_null(b):
        return failing(f"unsupported operand for {op}: none", DOUBLE)
    base = errs(a.err, b.err)
    if op == "+" and is_text(a) and is_text(b):
        return Val(F.concat(a.col, b.col), STRING, errs(base, _missing(op, a, b)), a.nullable or b.nullable)
    if op == "+" and is_list(a) and is_list(b):
        kind = joint_kind([a.kind.elementType, b.kind.elementType])
        to = T.ArrayType(kind)
        return Val(F.concat(a.col.cast(to), b.col.cast(to)), to, errs(base, _missing(op, a, b)))
    if op == "*" and is_text(a) and is_int(b):
        return Val(F.repeat(a.col, b.col.cast("int")), STRING, errs(base, _missing(op, a, b)))
    if not (is_number(a) and is_number(b)):
        return failing(f"unsupported operands for {op}: {kind_name(a)} and {kind_name(b)}", DOUBLE)
    whole = is_int(a) and is_int(b)
    x, y = (number(a), number(b)) if whole else (a.col.cast("double"), b.col.cast("double"))
    if op == "/":
        zero = when_err(y == 0, "division by zero")
        return Val(F.try_divide(x.cast("double"), y.cast("double")), DOUBLE, errs(base, _missing(op, a, b), zero))
    if op == "%":
        zero = when_err(y == 0, "division by zero")
        divisor = F.nullif(y, F.lit(0).cast("bigint") if whole else F.lit(0.0))
        rest = x % divisor
        fixed = F.when((rest != 0) & ((rest < 0) != (divisor < 0)), rest + divisor).otherwise(rest)
        return Val(fixed, LONG if whole else DOUBLE, errs(base, _missing(op, a, b), zero))
    if whole:
        got = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
        over = when_err(got.isNull(), "whole number beyond 64 bits")
        return Val(got, LONG, errs(base, _missing(op, a, b), over), a.nullable or b.nullable)
    got = x + y if op == "+" else x - y if op == "-" else x * y
    return Val(got, DOUBLE, errs(base, _missing(op, a, b)), a.nullable or b.nullable)


def negative(a: Val) -> Val:
    if not is_number(a):
        return failing(f"unsupported operand for -: {kind_name(a)}", DOUBLE)
    return Val(-number(a), LONG if is_int(a) else DOUBLE, errs(a.err, _missing("-", a)), a.nullable)


def equal(a: Val, b: Val) -> Column:
    """Two-valued: none equals none only; NaN equals nothing."""
    if is_null(a) or is_null(b):
        other = b if is_null(a) else a
        return F.lit(True) if is_null(other) else other.col.isNull()
    if is_number(a) != is_number(b) or is_text(a) != is_text(b):
        return a.col.isNull() & b.col.isNull()
    if is_number(a) and is_number(b):
        x, y = (number(a), number(b)) if is_int(a) and is_int(b) else (a.col.cast("double"), b.col.cast("double"))
    else:
        x, y = a.col, b.col
    got = x.eqNullSafe(y)
    for v in (a, b):
        if is_real(v):
            got = got & ~F.coalesce(F.isnan(v.col.cast("double")), F.lit(False))
    return got


def compare(op: str, a: Val, b: Val) -> Val:
    base = errs(a.err, b.err)
    if op in ("==", "!="):
        same = equal(a, b)
        return Val(same if op == "==" else ~same, BOOL, base, False)
    if is_null(a) or is_null(b):
        return failing(f"unsupported operand for {op}: none", BOOL)
    comparable = (is_number(a) and is_number(b)) or (is_text(a) and is_text(b)) or (a.kind == b.kind)
    if not comparable:
        return failing(f"unsupported operands for {op}: {kind_name(a)} and {kind_name(b)}", BOOL)
    if is_number(a):
        x, y = (number(a), number(b)) if is_int(a) and is_int(b) else (a.col.cast("double"), b.col.cast("double"))
    else:
        x, y = a.col, b.col
    got = x > y if op == ">" else x < y if op == "<" else x >= y if op == ">=" else x <= y
    for v in (a, b):
        if is_real(v):
            got = got & ~F.isnan(v.col.cast("double"))
    return Val(got, BOOL, errs(base, _missing(op, a, b)), a.nullable or b.nullable)


def logic(op: str, a: Val, b: Val) -> Val:
    """The deciding operand, as the language has it; where the two have no
    common type, whether it is true."""
    hold = truthy(a)
    b_err = None if b.err is None else F.when(hold if op == "and" else ~hold, b.err)
    try:
        kind = joint_kind([a.kind, b.kind])
    except PipeError:
        both = (hold & truthy(b)) if op == "and" else (hold | truthy(b))
        return Val(both, BOOL, errs(a.err, b_err), False)
    x, y = a.col.cast(kind), b.col.cast(kind)
    if isinstance(kind, T.BooleanType) and not a.nullable and not b.nullable:
        return Val(x & y if op == "and" else x | y, BOOL, errs(a.err, b_err), False)
    got = F.when(hold, y).otherwise(x) if op == "and" else F.when(hold, x).otherwise(y)
    return Val(got, kind, errs(a.err, b_err))


def _real_text(x: Column) -> Column:
    """A real number as the language writes it, by text functions alone: plain
    digits from 1e-4 up to 1e16, else ``1e+16``. The digits are the JVM's."""
    t = F.abs(x).cast("string")
    sign = F.when((x < 0) | (x.cast("string").startswith("-")), "-").otherwise("")
    mantissa, power = F.split_part(t, F.lit("E"), F.lit(1)), F.split_part(t, F.lit("E"), F.lit(2)).try_cast("int")
    short = F.regexp_replace(mantissa, r"\.0$", "")
    digits = F.replace(short, F.lit("."), F.lit(""))
    n = F.char_length(digits)
    longer = F.concat(digits, F.repeat(F.lit("0"), power + 1 - n), F.lit(".0"))
    inside = F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    tens = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.char_length(F.abs(power).cast("string"))), F.lit("0")))
    plain = F.when(~F.contains(t, F.lit("E")), t).when(power.between(0, 15), F.when(n <= power + 1, longer).otherwise(inside))
    body = plain.when(power.between(-4, -1), small).otherwise(F.concat(short, F.lit("e"), tens))
    return F.when(F.isnan(x), F.lit("nan")).when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, body))


def as_text(v: Val, none: str | None = "None") -> Val:
    """Text as the language writes values."""
    if is_null(v):
        return literal(none)
    if is_text(v):
        got = v.col
    elif isinstance(v.kind, T.BooleanType):
        got = F.when(v.col, "True").when(~v.col, "False")
    elif is_real(v):
        got = _real_text(v.col.cast("double"))
    elif is_int(v):
        got = v.col.cast("string")
    else:
        got = F.to_json(v.col)
    return Val(got if none is None else F.coalesce(got, F.lit(none)), STRING, v.err, none is None and v.nullable)


def as_int(v: Val) -> Val:
    if is_null(v):
        return Val(F.lit(None).cast("bigint"), LONG, v.err)
    if is_int(v):
        return Val(v.col.cast("bigint"), LONG, v.err, v.nullable)
    if is_real(v):
        x = v.col.cast("double")
        real = F.when(~F.isnan(x), x)
        got = F.when(F.abs(real) < 9.2e18, real).try_cast("bigint")
        return Val(got, LONG, errs(v.err, when_err(real.isNotNull() & got.isNull(), "whole number beyond 64 bits")))
    if is_text(v):
        trimmed = F.trim(v.col)
        got = F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), trimmed).try_cast("bigint")
        return Val(got, LONG, errs(v.err, when_err(v.col.isNotNull() & got.isNull(), "no whole number in this text")))
    return failing(f"int() of {kind_name(v)}", LONG)


def as_float(v: Val) -> Val:
    if is_null(v):
        return failing("float() of none", DOUBLE)
    if is_number(v):
        return Val(v.col.cast("double"), DOUBLE, errs(v.err, _missing("float()", v)), v.nullable)
    if is_text(v):
        trimmed = F.trim(v.col)
        got = F.when(trimmed.rlike(r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|nan|inf|infinity)$"), trimmed).try_cast("double")
        return Val(got, DOUBLE, errs(v.err, _missing("float()", v), when_err(got.isNull(), "no number in this text")))
    return failing(f"float() of {kind_name(v)}", DOUBLE)
