r"""Secret scans by multipart credential linking.

Three strong kinds are reported wherever they stand (``BASE_KINDS``). Three weak kinds,
which alone are mostly noise, are reported only if complementary parts stand together:
an *identifier* and a *secret key* within ``reach`` code points of each other in one scope, or
an *endpoint* and a secret key. A scope is a run of lines without a blank line between them.
The join of the parts is an interval join by sweep: parts are sorted by position, and
each looks at the nearest part behind it and at how far those before it reach, so its cost follows the number of parts and not
the number of pairs.

Defined results: null and empty texts have no spans; every row gives one row, repeated rows
repeat; an empty table gives an empty table; positions are code points, end exclusive. Texts of any length are scanned whole.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import prepare, releasing

BASE_KINDS = ("assign", "access", "hex")
LINKED_KINDS = ("identifier", "secret_key", "endpoint")
KINDS = BASE_KINDS + LINKED_KINDS

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
#: Without one of these, lower case, no assignment can match.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{12,40}(?![A-Za-z0-9])")
SECRET_KEY = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?=[^\s]{0,63}[0-9])(?=[^\s]{0,63}[A-Z])(?=[^\s]{0,63}[a-z])[A-Za-z0-9+/_-]{32,64}(?![A-Za-z0-9+/_-])"
)
ENDPOINT = re.compile(r"(?:https?|amqp|postgres(?:ql)?|mysql|redis|mongodb|s3)://[A-Za-z0-9._:@-]+")
SCOPE_END = re.compile(r"\n[ \t\r]*\n")
#: Code points between two parts of one credential.
REACH = 200


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the strong kinds, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return found


def linked_spans(text: str, base: list[tuple[str, int, int, int]], reach: int = REACH) -> list[tuple[str, int, int, int]]:
    """The weak parts that have a complementary part within reach and scope."""
    secrets = [(m.start(), m.end()) for m in SECRET_KEY.finditer(text)]
    strong = [(s, e, k) for k, s, e, _ in base]
    identifiers = [(s, e) for s, e, k in strong if k == "access"]
    if not secrets and not strong:
        return []
    taken = sorted((s, e) for s, e, _ in strong)
    ends_so_far = list(accumulate((e for _, e in taken), max))

    def free(s: int, e: int) -> bool:
        """Not a part of a strong span."""
        i = bisect.bisect_left(taken, (e, -1))
        return i == 0 or ends_so_far[i - 1] <= s

    weak_ids = [(m.start(), m.end()) for m in IDENTIFIER.finditer(text) if free(m.start(), m.end())]
    weak_keys = [(s, e) for s, e in secrets if free(s, e)]
    ends = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    breaks = [m.start() for m in SCOPE_END.finditer(text)] if "\n" in text else []
    keys = sorted(weak_keys + [(s, e) for s, e, k in strong if k != "access"])
    marks = sorted(identifiers + weak_ids + ends)

    def beside(others: list[tuple[int, int]]) -> Callable[[int, int], bool]:
        """Tells whether one of the sorted others stands within reach of a part, in its scope.

        Of those that start later the first is nearest; of those before, the one that ends last in the scope.
        """
        scopes = [bisect.bisect_right(breaks, s) for s, _ in others]
        last: list[int] = []
        for i, (_, e) in enumerate(others):
            last.append(max(e, last[-1]) if i and scopes[i] == scopes[i - 1] else e)

        def near(s: int, e: int) -> bool:
            scope, i = bisect.bisect_right(breaks, s), bisect.bisect_left(others, (s, -1))
            return i < len(others) and scopes[i] == scope and others[i][0] - e <= reach or i > 0 and scopes[i - 1] == scope and s - last[i - 1] <= reach

        return near

    by_key, by_mark = beside(keys), beside(marks)
    out = [("identifier", s, e, s) for s, e in weak_ids if by_key(s, e)]
    out += [("secret_key", s, e, s) for s, e in weak_keys if by_mark(s, e)]
    out += [("endpoint", s, e, s) for s, e in ends if by_key(s, e)]
    return out


def ordered(spans: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in ordered(spans))


def redact(text: str, spans: list[tuple[str, int, int, int]]) -> str:
    """Each run of overlapping values becomes ``[kind]`` of its first span."""
    out, at = [], 0
    for kind, _, end, value in sorted(spans, key=lambda x: (x[3], -x[2])):
        if value >= at:
            out += [text[at:value], f"[{kind.upper()}]"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


SCHEMA = (
    "array<struct<kind:string,start:int,end:int,value_start:int>>"
)


def scan(docs: DataFrame, text: str = "text", reach: int = REACH, with_redacted: bool = False) -> DataFrame:
    """``docs`` with ``secret_spans`` (array of kind, start, end, value_start) and, if asked, ``redacted`` text.

    One pass without a shuffle; the columns of ``docs`` are kept, whatever their names
    (the two new names are replaced if they exist).
    """
    prepare(docs.sparkSession)
    kept = docs.drop("secret_spans", "redacted")
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, clean = [], []
            for value in batch.column(text).to_pylist():
                own = value or ""
                base = base_spans(own)
                found = ordered(base + linked_spans(own, base, reach))
                spans.append([{"kind": k, "start": s, "end": e, "value_start": v} for k, s, e, v in found])
                if with_redacted:
                    clean.append(redact(own, found) if found else value)
            arrays, names = list(batch.columns), list(batch.schema.names)
            arrays.append(pa.array(spans, span))
            names.append("secret_spans")
            if with_redacted:
                arrays.append(pa.array(clean, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    fields.append(f"secret_spans {SCHEMA}")
    if with_redacted:
        fields.append("redacted string")
    return kept.mapInArrow(releasing(run), ", ".join(fields))


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the strong kinds, the digest of their spans and all spans, per document."""
    found = scan(docs.select("doc_id", "text")).drop("text")
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("secret_spans")).alias("spans"),
    )
