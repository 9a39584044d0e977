"""Verdicts on URLs: rules on hosts and paths, then a list of canonical URLs.

Rules are few and compiled into one expression. A URL that no rule fits is blocked if
its canonical form is on a list of any length. The list is made into a blocked Bloom
filter: a key's hash names a block of eight longs, in each of which one bit is
set, so a probe is one look-up. Blocks are built by ``bit_or`` and broadcast, as
there are ``MAX_BLOCKS`` at most; a list too long for them only lets more keys
through. What passes the filter meets the list in an exact hash join, which removes
false positives; all other rows are never shuffled. DataFrame operations alone.

The canonical form drops the scheme, the ports 80 and 443, a leading ``www.`` or ``m.``,
the fragment, tracking parameters, a last ``/``, ``index.html`` and ``.html``; the
host is lower-cased (A-Z) and the parameters left are sorted.

Edge cases: a null URL or one without ``://`` has an empty host and path, no rule fits
it, it is on no list and allowed; null and repeated ids pass through row by row; an empty
table gives no rows, an empty list blocks nothing; other columns are kept, and those
named like a result are replaced.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import written

LANES, KEYS_PER_BLOCK = 8, 40  # 512 bits a block: nearly 13 for each key
MAX_BLOCKS = 1 << 18  # 16 MB of bits
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
# Bound of what is put into one expression.
MAX_RULES = 1000


class Rule(NamedTuple):
    action: str  # allow or block
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    lower = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for all spellings of an address; null where there is no host."""
    host, path = host_and_path(url)
    site = F.regexp_replace(F.regexp_replace(host, r":(80|443)\z", ""), r"^(www|m)\.", "")
    page = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html\z", ""), r"/\z", "")
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.sort_array(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(site, page, query))


def tracked(url: Column) -> Column:
    """Whether the address carries a tracking parameter."""
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.coalesce(F.exists(F.split(asked, "&"), lambda p: p.rlike(TRACKING)), F.lit(False))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The name and action of the longest rule that fits, of equally long ones that with the longer host."""
    if len(rules) > MAX_RULES or any(r.action not in ("allow", "block") for r in rules):
        raise ValueError(f"rules allow or block, and there are {MAX_RULES} at most")
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, action = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.action).otherwise(action)
    return name, action


# ---- the filter -----------------------------------------------------------------


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """A bit for each lane, from a second hash."""
    h = F.xxhash64(F.lit("lane"), key)
    place = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(LANES)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in place]


def bloom(listed: DataFrame, key: str, count: int) -> tuple[DataFrame, int]:
    """``block, lane0 .. lane7`` of the keys, and the number of blocks the filter is made for."""
    blocks = min(MAX_BLOCKS, max(1, -(-count // KEYS_PER_BLOCK)))
    lanes = [F.bit_or(b).alias(f"lane{i}") for i, b in enumerate(_bits(F.col(key)))]
    return listed.groupBy(_block(F.col(key), blocks).alias("block")).agg(*lanes), blocks


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``listed`` has a column ``url`` of addresses to block, in any spelling and order.
    """
    keys = written(listed.select(canonical(F.col("url")).alias("key")).where("key IS NOT NULL").distinct(), "url-list")
    filter_, blocks = bloom(keys, "key", keys.count())
    host, path = host_and_path(F.col(f"x.`{url_col}`"))
    name, action = ruled(F.col("r.host"), F.col("r.path"), rules)
    # All of the page in one struct: its columns meet no others.
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("x"))
    rows = rows.withColumn("r", F.struct(host.alias("host"), path.alias("path")))
    rows = rows.withColumns({"name": name, "action": action})
    rows = rows.withColumn("key", F.when(F.col("action").isNull(), canonical(F.col(f"x.`{url_col}`"))))
    probed = rows.join(F.broadcast(filter_), _block(F.col("key"), blocks) == F.col("block"), "left")
    hits = [(F.col(f"lane{i}").bitwiseAND(b) != 0) for i, b in enumerate(_bits(F.col("key")))]
    hit = F.col("key").isNotNull() & F.coalesce(reduce(lambda a, b: a & b, hits), F.lit(False))
    probed = probed.select("x", "r", "name", "action", F.when(hit, F.col("key")).alias("key"))
    passed = probed.where("key IS NOT NULL").alias("p")
    exact = passed.join(keys.select(F.col("key").alias("found")).hint("shuffle_hash"), F.col("p.key") == F.col("found"), "left")
    exact = exact.withColumn("action", F.when(F.col("found").isNotNull(), "block")).select("x", "r", "name", "action")
    both = exact.unionByName(probed.where("key IS NULL").drop("key"))
    result = {"host": F.col("r.host"), "path": F.col("r.path"), "rule": F.col("name"), "verdict": F.coalesce("action", F.lit("allow"))}
    kept = [F.col(f"x.`{c}`") for c in pages.columns if c not in result]
    return both.select(*kept, *[c.alias(n) for n, c in result.items()])
