"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

The patterns (assignments, access keys, long hex strings) find the known shapes. The novelty method then looks at
every other string of 16 or more key characters in sensitive context, which is the line of a sensitive word and the
line after it, however long they are. A zstandard compressor is primed with a dictionary of common identifiers and with
the text around the string (the string left out), and the string's marginal compressed bytes are measured. Names, paths
and prose come cheap, because the dictionary or the surroundings hold their parts. What the bytes are held against
is the same measure for the string's own characters in shuffled order: a random key is no cheaper than that, whatever
its alphabet and length, and is reported as `novel`. A string without digits must also change between cases and marks
as often as a random one would, as words that nothing nearby holds cannot be told from chance by their bytes alone.

A text is read once for its sensitive words and once for its candidates, so the work grows with its length.

Spans count code points, end exclusive, and are listed as kind:start:end by start, then kind (assign, access, hex,
novel). Defined results: a null text is an empty one, without spans. Repeated rows are scanned each; null ids stay.
"""

from __future__ import annotations

import bisect
import random
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
# A run of these characters is one match, so the length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that make their surroundings sensitive.
SENSITIVE = re.compile(r"(?<![a-z])(?:passw|passphrase|pwd|secret|token|api[_ -]?key|apikey|credential|bearer|authorization|private[_ -]?key|access[_ -]?key|client[_ -]?id|signature|jwt|hmac|salt|dsn|connection[_ -]?string)", re.IGNORECASE | re.ASCII)
HINTS = ("passw", "passp", "pwd", "secret", "token", "key", "credential", "bearer", "authorization", "client", "signature", "jwt", "hmac", "salt", "dsn", "connection")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~!@#$%^&*-]{16,}")
#: Characters on either side that prime the compressor; the share of the shuffled string's bytes that a key costs at least.
AROUND, NOVEL_SHARE = 512, 0.88
#: Distinct characters of a key at least; changes of class for each character of a string without digits.
DISTINCT, CHANGES = 6, 0.4
#: Common identifiers and phrases of code and configuration.
IDENTIFIERS = (
    "password passwd secret token api_key apiKey access_key client_id client_secret private_key public_key authorization bearer username "
    "config settings environment localhost database connection string request response header content_type application json https http www "
    "import from return function class const public static void self this null true false default example placeholder changeme "
    "getElementById querySelector addEventListener createElement innerHTML toString valueOf hasOwnProperty prototype constructor "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 xxxxxxxxxxxxxxxx ---------------- ================ ________________"
).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    lower = text.lower()
    out = []
    if "passw" in lower or "secret" in lower or "token" in lower or "api" in lower:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def compressor(before: str, after: str) -> zstandard.ZstdCompressor:
    """One that knows the identifier dictionary and the text around a string."""
    prime = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + after.encode() + b"\n" + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=prime, write_checksum=False, write_content_size=False, write_dict_id=False)


def novel(word: str, before: str, after: str) -> bool:
    """Whether word costs about as many bytes beside its surroundings as its characters do in shuffled order."""
    if len(set(word)) < DISTINCT:
        return False
    if not any(x.isdigit() for x in word):
        kinds = [0 if x.islower() else 1 if x.isupper() else 2 for x in word]
        if sum(x != y for x, y in zip(kinds, kinds[1:])) < CHANGES * (len(word) - 1):
            return False
    # Copies of the string nearby must not make it look familiar.
    make = compressor(before.replace(word, " "), after.replace(word, " "))
    base = len(make.compress(b""))
    cost = len(make.compress(word.encode())) - base
    shuffled = [len(make.compress("".join(random.Random(seed).sample(word, len(word))).encode())) - base for seed in (1, 2, 3)]
    return cost >= NOVEL_SHARE * sum(shuffled) / len(shuffled)


def sensitive_lines(text: str) -> list[tuple[int, int]]:
    """(start, end) of every line that holds a sensitive word, with the line after it; in order, overlaps joined."""
    out: list[tuple[int, int, int]] = []
    for m in SENSITIVE.finditer(text):
        if out and m.start() < out[-1][2]:  # on the last word's own line
            continue
        start = text.rfind("\n", 0, m.start()) + 1
        own = text.find("\n", m.end())
        own = len(text) if own < 0 else own
        end = text.find("\n", own + 1)
        out.append((start, len(text) if end < 0 else end, own))
    joined: list[tuple[int, int]] = []
    for a, b, _ in out:
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    lower = text.lower()
    if not any(h in lower for h in HINTS):
        return []
    out, spans = [], []  # base spans joined, so that one pointer tells whether a candidate meets one
    for a, _, b in base:
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    ends = [b for _, b in spans]
    for low, high in sensitive_lines(text):
        for c in CANDIDATE.finditer(text, low, high):
            i = bisect.bisect_right(ends, c.start())
            if i < len(spans) and spans[i][0] < c.end():
                continue
            if novel(c.group(), text[max(0, c.start() - AROUND) : c.start()], text[c.end() : c.end() + AROUND]):
                out.append((c.start(), 3, c.end()))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """text with every maximal run of overlapping spans replaced by mark."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, base, spans): the fixed patterns' spans and all spans, as lists in text form."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            base, every = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                found = base_spans(text)
                base.append(found)
                every.append(sorted(found + novel_spans(text, found)))
            counts = [pa.array([sum(k == j for _, k, _ in x) for x in base], pa.int64()) for j in range(3)]
            texts = [pa.array([listed(x) for x in base], pa.string()), pa.array([listed(x) for x in every], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, *texts], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string")


def redact_secrets(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every span in text_col replaced by mark, and length_col (if there is one) set anew where the text changed."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index(text_col)
            old = b.column(i).to_pylist()
            new = []
            for t in old:
                found = base_spans(t) if t else []
                spans = found + novel_spans(t, found) if t else []
                new.append(redact(t, spans, mark) if spans else t)
            columns = list(b.columns)
            columns[i] = pa.array(new, b.schema.field(i).type)
            j = b.schema.get_field_index(length_col)
            if j >= 0 and pa.types.is_integer(b.schema.field(j).type):
                columns[j] = pa.array([n if x is y or y is None else len(y) for n, x, y in zip(b.column(j).to_pylist(), old, new)], b.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
