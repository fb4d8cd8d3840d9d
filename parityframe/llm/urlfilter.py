"""URL filters (operator 11): block and allow rules held as sorted digest arrays.

A rule is a string, host then path: ``net/``, ``example.net/en/``. It fits its
host and every subdomain if the url's path starts with the rule's path (a rule
without ``/`` has an empty path, which every path starts with). Of several
fitting rules the longest string wins, of equally long ones that with the longer
host. A rule listed with both verdicts blocks.

The rules become two arrays, written as one file into the shared folder and given
to the executors with ``addFile``: the hosts with the lengths of their paths,
and the rules with their verdicts. Each array has the keys' 64-bit xxhash
digests, sorted, then the keys themselves. A task maps the file into memory (its
pages are shared by all workers of a machine), probes the digests of a whole
batch by one vectorised binary search, and compares the stored strings, so that
two keys of one digest are told apart. Only suffixes of a host at label borders
that are no longer than the longest rule host are probed, and for those that are
rule hosts only the path lengths that occur there, so a long url costs no more
than its length.

The rule list is measured first (``most_bytes``). A longer list is neither
collected nor sent whole: it is joined by Spark (``_joined``), with the same rows.

Defined results: the host is what follows the first ``://`` up to ``/``, ``?``,
``#`` or the end, A-Z lower-cased (ports and user names are part of it); the path
goes on up to ``?``, ``#`` or the end. A null url, or one without ``://``, has an
empty host and path, fits no rule with a host and gets the default verdict. An
empty table gives no rows; repeated rows are judged each; an empty rule list gives
the default everywhere; null rules are left out. Columns of the input named host,
path, rule or verdict are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityframe.llm.common import read_table, shared_path, ship

#: Bytes of rules up to which the arrays are built and sent.
MOST_BYTES = 256 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------------ digest arrays
def digests(keys: Sequence[bytes], bits: int = 64) -> np.ndarray:
    """The keys' xxhash digests; fewer ``bits`` make collisions (for tests)."""
    found = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
    return found >> np.uint64(64 - bits) if bits < 64 else found


def pack(items: dict[bytes, bytes], bits: int = 64) -> bytes:
    """An array's bytes: count and bits, sorted digests, ends of keys, ends of
    payloads, keys, payloads; padded to eight bytes."""
    keys = list(items)
    d = digests(keys, bits)
    order = np.argsort(d, kind="stable")
    keys = [keys[i] for i in order]
    values = [items[k] for k in keys]
    head = np.array([len(keys), bits], np.uint64)
    ends = [np.cumsum([0, *map(len, x)]).astype(np.uint64) for x in (keys, values)]
    blob = b"".join([head.tobytes(), d[order].tobytes(), *(e.tobytes() for e in ends), *keys, *values])
    return blob + b"\0" * (-len(blob) % 8)


class DigestArray:
    """One array inside a mapped file."""

    def __init__(self, data: np.ndarray, at: int):
        def take(n):
            nonlocal at
            at += 8 * n
            return data[at - 8 * n:at].view(np.uint64)
        n, self.bits = map(int, take(2))
        self.digests, self._key_ends, self._value_ends = take(n), take(n + 1), take(n + 1)
        self._keys = data[at:at + int(self._key_ends[-1])]
        at += len(self._keys)
        self._values = data[at:at + int(self._value_ends[-1])]
        at += len(self._values)
        self.end = at + -at % 8

    def key(self, i: int) -> bytes:
        return self._keys[int(self._key_ends[i]):int(self._key_ends[i + 1])].tobytes()

    def value(self, i: int) -> bytes:
        return self._values[int(self._value_ends[i]):int(self._value_ends[i + 1])].tobytes()

    def find(self, keys: Sequence[bytes]) -> np.ndarray:
        """Place of each key, -1 if it is not in the array."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not len(keys):
            return out
        d = digests(keys, self.bits)
        begin = np.searchsorted(self.digests, d, "left")
        hit = np.flatnonzero(self.digests[np.minimum(begin, len(self.digests) - 1)] == d)
        for i in hit[begin[hit] < len(self.digests)]:
            at = int(begin[i])
            while at < len(self.digests) and self.digests[at] == d[i]:
                if self.key(at) == keys[i]:
                    out[i] = at
                    break
                at += 1
        return out


class UrlIndex:
    """Both arrays of a rule list, from a file's bytes."""

    def __init__(self, data: np.ndarray):
        self.hosts = DigestArray(data, 0)
        self.rules = DigestArray(data, self.hosts.end)
        self.longest_host = max((int(n) for n in np.diff(self.hosts._key_ends)), default=-1)

    @staticmethod
    def file(rules: dict[str, str], bits: int = 64) -> bytes:
        """The file of {rule: verdict}."""
        lengths: dict[bytes, set] = {}
        for rule in rules:
            host, slash, rest = rule.partition("/")
            lengths.setdefault(host.encode(), set()).add(len((slash + rest).encode()))
        return pack({h: np.array(sorted(n), np.uint32).tobytes() for h, n in lengths.items()}, bits) + pack(
            {r.encode(): v.encode() for r, v in rules.items()}, bits)

    def suffixes(self, host: bytes) -> list[bytes]:
        found = [host] if len(host) <= self.longest_host else []
        at = host.find(b".", max(0, len(host) - self.longest_host - 1))
        while at >= 0:
            found.append(host[at + 1:])
            at = host.find(b".", at + 1)
        return found

    def judge(self, hosts: list[str], which: np.ndarray, paths: list[str]) -> tuple[list, list]:
        """Winning rule and verdict (or None) of each url; url i has the host
        hosts[which[i]] and the path paths[i]."""
        tails = [self.suffixes(h.encode()) for h in hosts]
        places = self.hosts.find([s for t in tails for s in t])
        known, at = [], 0
        for t in tails:
            known.append([(s, np.frombuffer(self.hosts.value(int(p)), np.uint32).tolist())
                          for s, p in zip(t, places[at:at + len(t)]) if p >= 0])
            at += len(t)
        probes, owner = [], []
        for i, w in enumerate(which):
            if known[w]:
                path = paths[i].encode()
                for suffix, lengths in known[w]:
                    for n in lengths:
                        if n > len(path):
                            break
                        probes.append(suffix + path[:n])
                        owner.append((i, len(suffix)))
        best: list = [None] * len(paths)
        for probe, (i, host), p in zip(probes, owner, self.rules.find(probes)):
            if p >= 0:
                rule = probe.decode()
                best[i] = max(best[i] or (-1, -1), (len(rule), host, rule, int(p)))
        return [b and b[2] for b in best], [b and self.rules.value(b[3]).decode() for b in best]


_INDEXES: dict[str, UrlIndex] = {}


def _mapped(name: str) -> UrlIndex:
    """The worker's index, mapped once."""
    if name not in _INDEXES:
        _INDEXES[name] = UrlIndex(np.memmap(SparkFiles.get(name), np.uint8, "r"))
    return _INDEXES[name]


def _publish(spark: SparkSession, blob: bytes) -> str:
    """Write the file into the shared folder and have executors fetch it."""
    path = shared_path(spark, "url-index")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    for at in range(0, len(blob), 1 << 20):
        out.write(bytearray(blob[at:at + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


# ----------------------------------------------------------------- the operator
def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(rules: DataFrame) -> DataFrame:
    """Distinct (rule, verdict): hosts lower-cased, block before allow."""
    host = F.translate(F.regexp_extract("rule", r"^([^/]*)", 1), UPPER, LOWER)
    return (rules.where("rule IS NOT NULL").select(F.concat(host, F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)).alias("rule"), "verdict")
            .groupBy("rule").agg(F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise("allow").alias("verdict")))


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
               most_bytes: int = MOST_BYTES, bits: int = 64) -> DataFrame:
    """``urls`` plus host, path, rule (null if none fits) and verdict, by
    ``rules`` (rule, verdict: block or allow)."""
    spark = urls.sparkSession
    host, path = host_and_path(F.col(url_col))
    parsed = urls.withColumns({"__host": F.coalesce(host, F.lit("")), "__path": F.coalesce(path, F.lit(""))})
    parsed = parsed.drop("host", "path", "rule", "verdict").withColumnsRenamed({"__host": "host", "__path": "path"})
    listed = rule_table(rules)
    size = listed.agg(F.sum(2 * F.octet_length("rule") + 48).alias("n")).first()["n"] or 0
    if size > most_bytes:
        return _joined(parsed, listed, default)
    ship(spark)
    name = _publish(spark, UrlIndex.file({r["rule"]: r["verdict"] for r in listed.toLocalIterator()}, bits))
    schema = T.StructType([*parsed.schema, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _mapped(name)
        for batch in batches:
            # Repeated hosts are probed once.
            hosts = batch.column("host").dictionary_encode()
            rule, verdict = index.judge(hosts.dictionary.to_pylist(), hosts.indices.to_numpy(), batch.column("path").to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(rule, pa.string()),
                                   pa.array([v or default for v in verdict], pa.string())], names=schema.names)
    return parsed.mapInArrow(run, schema)


def _joined(parsed: DataFrame, listed: DataFrame, default: str) -> DataFrame:
    """The same by joins, for lists beyond the size bound: distinct hosts and
    paths meet the rule hosts, then the rules of the path lengths there."""
    split = listed.withColumns({"__at": F.regexp_extract("rule", r"^([^/]*)", 1)})
    lengths = split.groupBy(F.col("__at").alias("suffix")).agg(
        F.collect_set(F.char_length("rule") - F.char_length("__at")).alias("lengths"))
    urls = parsed.select("host", "path").distinct()
    # No suffix with more labels than the longest rule host can fit.
    labels = split.agg(F.max(F.size(F.split("__at", r"\."))).alias("n")).first()["n"] or 1
    tails = F.expr(f"transform(sequence(1, least({labels}, size(split(host, '[.]')))), k -> substring_index(host, '.', -k))")
    probes = (urls.select("host", "path", F.explode(tails).alias("suffix")).join(lengths, "suffix")
              .select("host", "path", "suffix", F.explode("lengths").alias("n")).where(F.col("n") <= F.char_length("path"))
              .select("host", "path", F.char_length("suffix").alias("h"),
                      F.concat("suffix", F.expr("substring(path, 1, n)")).alias("rule")))
    best = probes.join(listed, "rule").groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), F.struct(F.char_length("rule"), "h")).alias("won"))
    return parsed.join(best, ["host", "path"], "left").select(
        *parsed.columns, F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_RULE_SQL = ", ".join(f"('{r}', '{v}')" for r, v in RULES)
OP11_SQL = f"""WITH rules AS (SELECT rule, verdict, regexp_extract(rule, '^([^/]*)', 1) AS h, regexp_extract(rule, '^[^/]*(.*)$', 1) AS p
  FROM (VALUES {_RULE_SQL}) AS r(rule, verdict)),
cut AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT i, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT i, arg_max(rule, (length(rule), length(h))) AS rule, arg_max(verdict, (length(rule), length(h))) AS verdict
  FROM parsed, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN fits USING (i)"""
