"""The few places where Spark SQL and DuckDB SQL differ, so that a plan is stated once for both.

A plan is a function of a dialect that returns SQL text. Spark runs it over the tables' DataFrames; the other text is
its oracle.
"""

from __future__ import annotations


class Spark:
    def u(self, text: str) -> str:
        """A uniform whole number below 2**32 from a text's MD5 digest: the same under any partitioning."""
        return f"CAST(conv(substring(md5({text}), 1, 8), 16, 10) AS BIGINT)"

    def starts(self, a: str, b: str) -> str:
        return f"startswith({a}, {b})"

    def like(self, s: str, pattern: str) -> str:
        return f"({s} RLIKE r'{pattern}')"

    def sub(self, s: str, pattern: str, to: str) -> str:
        return f"regexp_replace({s}, r'{pattern}', '{to}')"

    def split(self, s: str, sep: str) -> str:
        """Split at a plain string."""
        return f"split({s}, '\\\\Q{sep}\\\\E')" if sep != "\n" else f"split({s}, '\\n')"

    def unnest(self, table: str, array: str, pos: str, value: str, columns: str) -> str:
        """A row for each element, with its place from 0."""
        return f"(SELECT {columns}, {pos}, {value} FROM {table} LATERAL VIEW posexplode({array}) AS {pos}, {value})"

    def join_rows(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def at(self, a: str, i: str) -> str:
        """Element by place from 0, null outside."""
        return f"get({a}, CAST({i} AS INT))"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def collect(self, x: str, order: str) -> str:
        """Values of a group in order."""
        return f"transform(sort_array(collect_list(struct({order}, {x} AS _x))), e -> e._x)"

    def fn(self, var: str, body: str) -> str:
        return f"{var} -> {body}"

    def filter(self, a: str, var: str, body: str) -> str:
        return f"filter({a}, {var} -> {body})"

    def map(self, a: str, var: str, body: str) -> str:
        return f"transform({a}, {var} -> {body})"

    def slice(self, a: str, start: str, length: str) -> str:
        """`length` elements from place `start`, which is counted from 1."""
        return f"slice({a}, CAST({start} AS INT), CAST({length} AS INT))"

    def joined(self, a: str, sep: str) -> str:
        return f"array_join({a}, '{sep}')"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def both(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def find_all(self, s: str, pattern: str) -> str:
        return f"regexp_extract_all({s}, r'{pattern}', 0)"

    def first(self, s: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({s}, r'{pattern}', {group})"

    def first_by(self, x: str, *keys: str) -> str:
        """The value of the row with the least keys."""
        return f"min_by({x}, struct({', '.join(keys)}))"

    def last_by(self, x: str, *keys: str) -> str:
        return f"max_by({x}, struct({', '.join(keys)}))"

    def json(self, s: str, key: str) -> str:
        return f"get_json_object({s}, '$.{key}')"

    def numbers(self, a: str, b: str) -> str:
        return f"sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT))"

    def left(self, s: str, n: str) -> str:
        return f"left({s}, CAST({n} AS INT))"

    def floor(self, x: str) -> str:
        return f"CAST(floor({x}) AS BIGINT)"


class Duck(Spark):
    def u(self, text):
        return f"CAST(CAST(('0x' || substr(md5({text}), 1, 8)) AS UBIGINT) AS BIGINT)"

    def starts(self, a, b):
        return f"starts_with({a}, {b})"

    def like(self, s, pattern):
        return f"regexp_matches({s}, '{pattern}')"

    def sub(self, s, pattern, to):
        return f"regexp_replace({s}, '{pattern}', '{to}', 'g')"

    def split(self, s, sep):
        return f"string_split({s}, '{sep}')" if sep != "\n" else f"string_split({s}, chr(10))"

    def unnest(self, table, array, pos, value, columns):
        return f"(SELECT {columns}, CAST(unnest(range(len(_a))) AS INT) AS {pos}, unnest(_a) AS {value} FROM (SELECT *, {array} AS _a FROM {table}) AS _t)"

    def join_rows(self, x, sep, order):
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    def size(self, a):
        return f"CAST(len({a}) AS BIGINT)"

    def at(self, a, i):
        return f"({a})[CAST({i} AS INT) + 1]"

    def array(self, *xs):
        return f"[{', '.join(xs)}]"

    def collect(self, x, order):
        return f"list({x} ORDER BY {order})"

    def fn(self, var, body):
        return f"lambda {var}: {body}"

    def filter(self, a, var, body):
        return f"list_filter({a}, lambda {var}: {body})"

    def map(self, a, var, body):
        return f"list_transform({a}, lambda {var}: {body})"

    def slice(self, a, start, length):
        return f"list_slice({a}, CAST({start} AS INT), CAST(({start}) + ({length}) - 1 AS INT))"

    def joined(self, a, sep):
        return f"array_to_string({a}, '{sep}')"

    def distinct(self, a):
        return f"list_distinct({a})"

    def both(self, a, b):
        return f"list_intersect({a}, {b})"

    def has(self, a, x):
        return f"list_contains({a}, {x})"

    def find_all(self, s, pattern):
        return f"regexp_extract_all({s}, '{pattern}')"

    def first(self, s, pattern, group=1):
        return f"regexp_extract({s}, '{pattern}', {group})"

    def first_by(self, x, *keys):
        return f"first({x} ORDER BY {', '.join(keys)})"

    def last_by(self, x, *keys):
        return f"last({x} ORDER BY {', '.join(keys)})"

    def json(self, s, key):
        return f"json_extract_string({s}, '$.{key}')"

    def numbers(self, a, b):
        return f"range(CAST({a} AS BIGINT), CAST({b} AS BIGINT) + 1)"
