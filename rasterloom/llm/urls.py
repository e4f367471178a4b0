"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed n-grams: the first 16 bits of their MD5 digest.
BUCKETS = 1 << 16
SIZES = (3, 4, 5)

# Words of the labelled table. A URL is labelled block where its host or path has a word of an unwanted
# topic (gambling, pharmacy, adult, advertising, spam and fraud), and allow where it has none.
UNWANTED = "casino poker slots jackpot betting bets roulette lottery pills meds pharmacy viagra adult xxx escort singles porn ads adserver banner popup tracker tracking clicks spam spammer linkfarm scam phishing warez loans payday prizes giveaway".split()
WANTED = list(dict.fromkeys("garden history kitchen weather music library school travel science sports museum market river mountain theatre nation anthem northern stories motion research recipes energy health teacher harbour painting language election station village weekend studio father other machine gallery heritage planet winter orchard cinema forest letters chess baking cycling railway castle theory painter nature island society hotel reading building writing spring clothing everything nothing thought method author south north earth month bridge ocean coffee fashion camera bicycle village doctor justice culture history atlas radio poetry novel grammar marathon football tennis pottery woodland seaside thermal anthology athlete thesis archive journal parish council hospital".split()))
MODIFIERS = "online best free cheap top mega hot my the win daily royal".split()
HOSTS = ["{a}-{m}.example.com", "{m}-{a}.example.net", "www.{a}{m}.example.org", "m.{a}.example.com", "blog.{m}{a}.example.net", "{a}.example.org"]
PATHS = ["/en/{n}", "/de/{n}.html", "/fr/{n}/", "/es/{n}", "", "/{a}/{n}", "/index.html"]
#: URLs of each word.
COPIES = 6
#: Rows of the labelled table by crc32 of the URL: remainder 0 of this is held out.
HELD_OUT = 4


def labelled_table() -> list[tuple[str, int]]:
    """(url, 1 for block) of every word in several hosts and paths, chosen by a checksum, and URLs without any host or path."""
    rows = [("", 0), ("http://", 0), ("http://a.com", 0), ("https://b.example.org/", 0), ("http://c.example.net/x", 0)]
    for label, words in ((1, UNWANTED), (0, WANTED)):
        for a in words:
            for k in range(COPIES):
                c = zlib.crc32(f"{a}{k}".encode())
                pick = lambda of, shift, c=c: of[(c >> shift) % len(of)]
                host, path = pick(HOSTS, 3), pick(PATHS, 9)
                rows.append((f"http://{host.format(a=a, m=pick(MODIFIERS, 15))}{path.format(a=a, n=c % 9000)}", label))
    return rows


def held_out(url: str) -> bool:
    return zlib.crc32(url.encode()) % HELD_OUT == 0


#: What the model learns from; the rest of the table measures it.
LABELLED = [r for r in labelled_table() if not held_out(r[0])]


def parts(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path): the host runs from the first `://` to `/`, `?`, `#` or the end, the path on to `?`, `#` or the end."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.replace("#", "?").partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.encode().lower().decode(), slash + path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The same as expressions."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^?#]*)", 1)
    return F.translate(F.regexp_extract(rest, "(?s)^[^/]*", 0), capitals, capitals.lower()), F.regexp_extract(rest, "(?s)/.*", 0)


def ruling(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, of equal length the first by text; null if none fits.

    rules (verdict, host, path): a rule fits its host and all its subdomains where the path starts with the rule's.
    """
    one = lambda v, h, p: F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(-len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.least(*(one(*r) for r in rules), none, none)


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the n-grams of host and path, each marked by where it is from."""
    own = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"{path}$")):
        for n in SIZES:
            own.update(f"{mark}{text[i : i + n]}" for i in range(len(text) - n + 1))
    return np.unique(np.array([int.from_bytes(hashlib.md5(g.encode(), usedforsecurity=False).digest()[:2], "big") for g in own], np.int64))


class UrlModel:
    """Binary logistic regression with unit-length rows, trained by full-batch gradient descent."""

    def __init__(self, labelled: list[tuple[str, int]], rounds: int = 2000, rate: float = 12.0, shrink: float = 2e-5):
        rows = [features(*parts(u)) for u, _ in labelled]
        y = np.array([label for _, label in labelled], float)
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        value = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(rows))))[of]
        self.weight, self.bias = np.zeros(BUCKETS), 0.0
        for _ in range(rounds):
            z = np.bincount(of, self.weight[at] * value, len(rows)) + self.bias
            off = 1 / (1 + np.exp(-z)) - y
            self.weight -= rate * (np.bincount(at, off[of] * value, BUCKETS) / max(1, len(rows)) + shrink * self.weight)
            self.bias -= rate * off.mean() if len(rows) else 0

    def score(self, host: str, path: str) -> float:
        """The probability of block."""
        own = features(host, path)
        return float(1 / (1 + np.exp(-self.bias - self.weight[own].sum() / np.sqrt(max(1, len(own))))))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: list[tuple[str, int]] = LABELLED, threshold: float = 0.5) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits), verdict, and the model's p_block, to nine decimals.

    The rule's verdict stands; else block if p_block reaches the threshold. A null url, or one without
    `://`, has an empty host and path and is judged on those. Repeated rows repeat; an empty table gives
    no rows; only page_id and url are read. Rules and the labelled table are small lists of the caller:
    rules are one expression, and only the n-grams need Python.
    """
    held = pages.sparkSession.sparkContext.broadcast(UrlModel(labelled))
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), *(c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"), strict=True)))
    ruled = cut.withColumn("own", ruling(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "own.rule", "own.verdict")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [round(held.value.score(h, t), 9) for h, t in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield batch.append_column("p_block", pa.array(p, pa.float64()))

    scored = ruled.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, p_block double")
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("p_block") >= threshold, "block").otherwise("allow")))


def judge_sql(rules: list[tuple[str, str, str]], labelled: list[tuple[str, int]] = LABELLED, threshold: float = 0.5) -> str:
    """DuckDB SQL of `judge` over pages; of the model it takes the weights as learned, which are numbers of the labelled table alone."""
    model = UrlModel(labelled)
    weights = ", ".join(f"({k}, {model.weight[k]!r}::double)" for k in map(int, np.flatnonzero(model.weight))).replace("np.float64(", "(")
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    grams = " union ".join(f"select host, path, md5('{mark}' || substr(t, cast(i as int), {n})) as m from (select distinct host, path, {text} as t from cut), range(1, 100000) r(i) where i <= length(t) - {n - 1}" for mark, text in (("h", "'^' || host || '$'"), ("p", "path || '$'")) for n in SIZES)
    return f"""with whole as (select page_id, url, strpos(url, '://') as k from pages),
rest as (select page_id, case when k > 0 then regexp_extract(substr(url, k + 3), '^[^?#]*') else '' end as r from whole),
cut as (select page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '/.*') as path from rest),
rules(v, h, p) as (values {listed}),
fits as (select distinct host, path, h || p as rule, v from cut join rules on (host = h or suffix(host, '.' || h)) and prefix(path, p) qualify row_number() over (partition by host, path order by length(h || p) desc, h || p, v) = 1),
weight(k, w) as (values {weights}),
grams as ({grams}), own as (select distinct host, path, cast(concat('0x', substr(m, 1, 4)) as int) as k from grams),
p as (select host, path, round(1 / (1 + exp(-({model.bias!r}) - sum(coalesce(w, 0)) / sqrt(greatest(1, count(*))))), 9) as p_block from own left join weight using (k) group by host, path)
select page_id, host, path, rule, coalesce(v, case when p_block >= {threshold} then 'block' else 'allow' end) as verdict, p_block from cut left join fits using (host, path) left join p using (host, path)""".replace("np.float64(", "(")
