"""The text commands: call syntax, argument lists and durations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Messages and units that users of the command line see or type.
NOT_A_CALL = "expected format CMD(arg1,arg2,...)"
OPEN_ESCAPE = "unfinished escape sequence in quotes"
OPEN_QUOTE = 'unterminated quote (")'
EMPTY_ARGUMENT = "empty argument not allowed"
BAD_TTL = "invalid TTL, use 10s, 5m, 2h"
USAGE = {"GET": "usage: GET(key)", "DELETE": "usage: DELETE(key)", "PUT": "usage:\n  PUT(key,value)\n  PUT(key,value,ttl)  // ttl like 10s, 5m, 2h"}
UNKNOWN = "unknown command"
NIL = "(nil)"
UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
# End of fixed values.

COMMAND = "struct<cmd:string,args:array<string>,ok:boolean,err:string>"


#: A whole quoted stretch, a comma outside quotes, or plain text.
_PIECE = re.compile(r'"((?:[^"\\]|\\.)*)"|(,)|([^",]+)', re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def split_arguments(text: str) -> tuple[list[str], str | None]:
    """Comma-separated arguments, trimmed; quotes protect commas, and backslash escapes only within them."""
    if not text.strip():
        return [], None
    args, at = [""], 0
    while at < len(text):
        m = _PIECE.match(text, at)
        if m is None:  # a quote that no other one ends
            return [], OPEN_ESCAPE if _ESCAPED.sub("", text[at:]).endswith("\\") else OPEN_QUOTE
        at = m.end()
        if m[2]:
            args.append("")
        elif m[3] is not None:
            args[-1] += m[3]
        else:
            args[-1] += _ESCAPED.sub(lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), m[1])
    args = [x.strip() for x in args]
    return (args, None) if all(args) else ([], EMPTY_ARGUMENT)


def parse_call(line: str | None) -> dict:
    """A line as command, arguments, whether it is well formed, and the message if not."""
    line = (line or "").strip()
    bare = line.upper()
    if bare in ("EXIT", "QUIT"):
        return {"cmd": bare, "args": [], "ok": True, "err": None}
    a, b = line.find("("), line.rfind(")")
    if not line:
        return {"cmd": None, "args": [], "ok": False, "err": ""}
    if a <= 0 or b < a:
        return {"cmd": None, "args": [], "ok": False, "err": NOT_A_CALL}
    args, err = split_arguments(line[a + 1 : b])
    return {"cmd": None if err else line[:a].strip().upper(), "args": args, "ok": err is None, "err": err}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("cmd", pa.string()), ("args", pa.list_(pa.string())), ("ok", pa.bool_()), ("err", pa.string())])
    for batch in batches:
        out = pa.array([parse_call(t) for t in batch.column("line").to_pylist()], kind)
        yield batch.append_column(pa.field("call", kind), out)


def parse_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (with a column ``line``) and the parsed ``call``: the tokenizer is a state machine, so Arrow batches."""
    names = ", ".join(f"`{n}` {t}" for n, t in lines.dtypes)
    return lines.mapInArrow(_parsed, f"{names}, call {COMMAND}")


def duration_ns(text: Column) -> Column:
    """Nanoseconds of a duration such as 1h30m, -5s, 1.5s or 0; null if it isn't one."""
    number, unit = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)", "(?:ns|us|µs|μs|ms|s|m|h)"
    valid = text.rlike(f"^[+-]?(?:{number}{unit})+$")
    parts = F.regexp_extract_all(text, F.lit(f"({number}{unit})"), F.lit(1))
    scale = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)])

    def one(p: Column) -> Column:
        n = F.regexp_extract(p, f"^({number})", 1)
        whole = F.regexp_extract(n, r"^([0-9]*)", 1)
        rest = F.regexp_extract(n, r"\.([0-9]*)", 1)
        per = F.element_at(scale, F.regexp_extract(p, f"({unit})$", 1))
        high = F.when(whole == "", 0).otherwise(F.try_to_number(whole, F.lit("9" * 19)).cast("long")) * per
        low = F.when(rest == "", 0.0).otherwise(F.concat(F.lit("0."), F.when(rest == "", "0").otherwise(rest)).cast("double") * per)
        return high + low.cast("long")

    total = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc + one(p))
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    return F.when(text.isin("0", "+0", "-0"), F.lit(0).cast("long")).when(valid, signed)
