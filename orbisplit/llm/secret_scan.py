"""Secrets in texts: an Aho-Corasick pass finds keywords, anchored patterns run only where one was hit, and
kinds that embed a checksum are validated against it.

One pass over the rows, no shuffle: each text is scanned whole, inside the Arrow batch it arrives in. Hex runs
have no keyword, so a single pattern of fixed minimum length looks for them.

Defined cases: a null text is empty; an empty text has no spans; ``start`` and ``end`` count code points, the
end exclusive; of one kind, spans never overlap (leftmost first); spans of different kinds may. A text of any length is scanned
whole; memory is its batch, or the text where it is longer. Repeated rows are
scanned each for itself, an empty table gives an empty one, further columns are left as they are.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbisplit.llm.common import bounded_batches

#: Fixed value: digits of the base-62 checksums.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Kind:
    """A kind of secret: keywords (lower case), the pattern that must start at the hit, and what a match must pass.

    ``group`` is the part that ``check`` sees. A match that fails still uses up its characters. Where ``stretch`` matches at a hit that
    has no match, no hit within that stretch has one: a long run of keywords is read once.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: str
    check: Callable[[str], bool]
    group: int = 0
    flags: int = 0
    stretch: str | None = None


def crc32_base62(token: str) -> bool:
    """Six base-62 digits at the end are the CRC-32 of what stands after the prefix."""
    body, given = token[4:-6], token[-6:]
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits == given


def json_web_token(token: str) -> bool:
    """The first part decodes to a JSON object that names an algorithm."""
    head = token.split(".")[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(found, dict) and "alg" in found


#: A line break, in texts or escaped in string literals, with the quotes and marks that may stand around it.
_BREAK = r"""(?:[\x20\t"',;]*+(?:\r\n?|\n|\\r\\n|\\n)[\x20\t"'>#*|]*+)"""
#: Base64 up to the end of its line.
_ALONE = r"[A-Za-z0-9+/]++={0,2}+(?=[\x20\t\"',;]*+(?:[\r\n]|\\[rn]|\Z))"
#: A private key from its header to the matching END line, if no other block begins before it. Without one: its header fields,
#: its lines that are base64 alone, and long base64 words on one line with what is left of the last.
PEM = (
    r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----(?:"
    r"(?s:(?:(?!-----BEGIN ).)*?)-----END \1-----"
    rf"|(?:{_BREAK}[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+)*+"
    rf"(?:{_BREAK}*+{_ALONE}(?:{_BREAK}{_ALONE})*+)?+"
    r"(?:(?:\s|\\[rn])*+[A-Za-z0-9+/]{32,}+={0,2}+(?:[\x20\t]++(?=[A-Za-z]*+[0-9+/=])[A-Za-z0-9+/]{1,31}+={0,2}+(?![A-Za-z0-9+/=]))?+)*+)"
)

#: In the order in which spans of one start are listed. Keywords and patterns.
KINDS: tuple[Kind, ...] = (
    Kind(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda value: len(value) >= 6,
        group=2,
        flags=re.ASCII | re.IGNORECASE,
    ),
    Kind("access", ("akia",), r"AKIA[A-Z0-9]+", lambda value: len(value) >= 20),
    Kind("hex", (), r"[0-9a-f]{24,}", lambda value: True),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", crc32_base62),
    Kind("npm", ("npm_",), r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", crc32_base62),
    Kind("jwt", ("eyj",), r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", json_web_token, stretch=r"eyJ[A-Za-z0-9_-]*+"),
    Kind("pem", ("-----begin",), PEM, lambda value: True),
)
BASE_KINDS = ("assign", "access", "hex")
SPAN = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


@cache
def _compiled() -> tuple[object, list[re.Pattern[str]], list[re.Pattern[str] | None]]:
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, kind in enumerate(KINDS):
        for word in kind.keywords:
            found.add_word(word, (k, len(word)))
    found.make_automaton()
    return found, [re.compile(kind.pattern, kind.flags) for kind in KINDS], [kind.stretch and re.compile(kind.stretch) for kind in KINDS]


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), sorted."""
    if not text:
        return []
    automaton, patterns, stretches = _compiled()
    lower = text.encode().lower().decode()  # A to Z only, so that places stay the same
    used = [0] * len(KINDS)
    out = []
    # No keyword of a kind lies within another, so hits of a kind come in the order of their starts.
    for last, (k, length) in automaton.iter(lower):
        start = last - length + 1
        if start < used[k]:
            continue
        if m := patterns[k].match(text, start):
            used[k] = m.end()
            if KINDS[k].check(m[KINDS[k].group]):
                out.append((start, k, m.end()))
        elif stretches[k] and (m := stretches[k].match(text, start)):
            used[k] = m.end()
    for k, kind in enumerate(KINDS):
        if not kind.keywords:
            out += [(m.start(), k, m.end()) for m in patterns[k].finditer(text)]
    out.sort()
    return out


def redacted(text: str) -> str:
    """Each stretch that spans cover becomes one mark, named by the kind that starts it."""
    out, at, stretch = [], 0, None
    for start, k, end in [*spans_of(text), (len(text) + 1, 0, 0)]:
        if stretch and start < stretch[1]:
            stretch[1] = max(stretch[1], end)
            continue
        if stretch:
            out += [text[at : stretch[0]], f"[REDACTED:{KINDS[stretch[2]].name}]"]
            at = stretch[1]
        stretch = [start, end, k]
    return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and ``spans``: an array of (kind, start, end), by start, then by the order of the kinds."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    kind = narrow.schema["k"].dataType
    out = T.StructType([T.StructField("k", kind), T.StructField("spans", SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [
                [{"kind": KINDS[k].name, "start": s, "end": e} for s, k, e in spans_of(t)] for t in batch.column("t").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found, of)], ["k", "spans"])

    return narrow.mapInArrow(run, out).withColumnRenamed("k", key)


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Every row with its secrets replaced, the count of characters renewed if there is one; null texts stay null."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at, count = names.index(text), names.index(n_chars) if n_chars in names else None
    # Columns travel under their places: names may clash.
    placed = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if count is not None:
                columns[count] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return placed.mapInArrow(run, placed.schema).toDF(*names)


def joined(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined; of the named kinds only, if any are named."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
