"""Join of names within one edit, by partitioned neighbourhoods (DataFrame functions only).

Distance: insertions, deletions and substitutions of one code point and exchanges of two neighbours (unrestricted
Damerau-Levenshtein). An exchange is two plain edits, so a pair at distance one is at most two plain edits apart. A name
of the left side is cut into three pieces, head, middle and tail; of three pieces one is surely within one plain edit.
Here more holds, as two plain edits of one exchange are neighbours. Where the edit lies:

- in the head, or across head and middle: the tail is whole and the middle loses its first letter at most;
- in the tail, or across middle and tail: the head is whole and the middle loses its last letter at most;
- in the middle: head and tail are whole.

So a piece is joined by its one-deletion variants, each together with the piece beside it that is surely whole: a piece
of five letters alone is shared by so many names that candidates would grow with the square of the tables. The right
side needs no variants. For each length that a partner can have (one less, the same, one more) it gives the substrings
that such variants equal, shifted by the difference of the lengths: a suffix, a prefix, or a prefix and a suffix. Names
of up to SHORT code points are one piece: both sides give their one-deletion variants. Candidates are verified on whole
names.

Both sides are reduced to distinct names before, so names that many rows share meet once. Nothing is broadcast by this
module; joins are by hash of a key, which Spark splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Names of up to so many code points are not cut; shorter pieces would be shared by all.
SHORT = 5


def _piece_lengths(m: Column) -> tuple[Column, Column, Column]:
    """Head, middle and tail of a name of m code points; the middle is never the shortest."""
    end = F.floor(m / 3).cast("int")
    return end, m - 2 * end, end


def _head(name: Column, n: Column) -> Column:
    return F.substring(name, F.lit(1), n)


def _tail(name: Column, n: Column) -> Column:
    return F.substring(name, F.length(name) - n + 1, n)


def _one_deleted(text: Column) -> Column:
    """The text without each of its letters in turn."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def _key(kind: int, m: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(kind), m.cast("int"), text)


def _variants(name: Column) -> Column:
    """Keys of the left side: one-deletion variants of a piece beside the whole piece."""
    m = F.length(name)
    a, b, c = _piece_lengths(m)
    head, middle, tail = _head(name, a), F.substring(name, a + 1, b), _tail(name, c)
    joined = [
        F.transform(_one_deleted(middle), lambda v: _key(1, m, F.concat(v, tail))),
        F.transform(_one_deleted(middle), lambda v: _key(2, m, F.concat(head, v))),
        F.transform(_one_deleted(head), lambda v: _key(3, m, F.concat(v, tail))),
    ]
    short = F.transform(_whole_variants(name), lambda v: _key(0, F.lit(0), v))
    return F.array_distinct(F.when(m > SHORT, F.concat(*joined)).otherwise(short))


def _whole_variants(name: Column) -> Column:
    """The name and its one-deletion variants."""
    return F.concat(F.array(name), _one_deleted(name))


def _substrings(name: Column) -> Column:
    """Keys of the right side: for each length m of a partner, the shifted substrings that its variants can equal."""
    n = F.length(name)
    keys = []
    for shift in (-1, 0, 1):
        m = n + shift
        a, b, c = _piece_lengths(m)
        keys.append(F.when(m > SHORT, F.array(
            _key(1, m, _tail(name, b - 1 + c)),
            _key(2, m, _head(name, a + b - 1)),
            _key(3, m, F.concat(_head(name, a - 1), _tail(name, c))),
        )).otherwise(F.array().cast("array<bigint>")))
    short = F.when(n <= SHORT + 1, F.transform(_whole_variants(name), lambda v: _key(0, F.lit(0), v))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(*keys, short))


def _exchanged(x: Column, y: Column) -> Column:
    """Whether exchanging two neighbours of x gives y; both of one length."""
    first = lambda i: F.substring(x, F.lit(1), i - 1)
    swap = lambda i: F.concat(first(i), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, F.length(x)))
    return F.exists(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: swap(i) == y)


def distance_to_one(x: Column, y: Column) -> Column:
    """0 or 1 where the distance is that; null beyond."""
    plain = F.levenshtein(x, y, 2)
    near = F.when(x == y, 0).when(plain == 1, 1)
    return near.when((plain == 2) & (F.length(x) == F.length(y)) & (F.length(x) > 1), F.when(_exchanged(x, y), 1))


def near_names(left: DataFrame, right: DataFrame, *, left_col: str = "name", right_col: str = "name") -> DataFrame:
    """(left_name, right_name, distance): all pairs of distinct names of both sides at distance 0 or 1.

    Null and empty names take no part; a name repeated on either side gives one pair; other columns are not read; with an
    empty side the result is empty. Names are compared as they are, by code point.
    """
    some = lambda df, c, to: df.select(F.col(c).alias(to)).where(F.col(to) != "").distinct()
    l_keys = some(left, left_col, "left_name").select("left_name", F.explode(_variants(F.col("left_name"))).alias("key"))
    r_keys = some(right, right_col, "right_name").select("right_name", F.explode(_substrings(F.col("right_name"))).alias("key"))
    # Hinted as a merge of sorted sides: it spills, and its skewed keys are split.
    met = l_keys.hint("merge").join(r_keys, "key").select("left_name", "right_name", distance_to_one(F.col("left_name"), F.col("right_name")).alias("distance"))
    return met.where(F.col("distance").isNotNull()).distinct()


def misspelt(name: Column, key: Column) -> Column:
    """The name with two neighbours exchanged at a place that the key's checksum decides, if that is even and there are two letters."""
    h, n = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.length(name)
    at = (F.pmod(h, F.greatest(n - 1, F.lit(1))) + 1).cast("int")
    swapped = F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.lit(1)), F.substring(name, at, F.lit(1)), F.substring(name, at + 2, n))
    return F.when((h % 2 == 0) & (n >= 2), swapped).otherwise(name)


def join_names(vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """Per vendor (vendor_id, name) and distance 0 or 1: how many client rows (client_id, name) are so near, the smallest id
    and the sum of the ids' checksums.

    Repeated client rows count each; repeated vendor rows (same id and name) count once, an id with several names has the
    rows of all. A null id is grouped as null (vendors), counts without being smallest and adds nothing to the sum (clients).
    """
    ids = F.crc32(F.coalesce(F.col("client_id").cast("string"), F.lit("")).cast("binary"))
    by_name = clients.where(F.col("name") != "").groupBy(F.col("name").alias("right_name")).agg(
        F.count(F.lit(1)).alias("n"), F.min("client_id").alias("least"), F.sum(ids).alias("crc"))
    told = vendors.where(F.col("name") != "").select("vendor_id", F.col("name").alias("left_name")).distinct()
    pairs = near_names(told, by_name, left_col="left_name", right_col="right_name")
    # Summed by name first: vendors that share a name share its sums.
    sums = pairs.join(by_name, "right_name").groupBy("left_name", "distance").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("crc").alias("crc"))
    return told.join(sums, "left_name").groupBy("vendor_id", "distance").agg(
        F.sum("n").cast("long").alias("n_clients"), F.min("least").cast("long").alias("first_client_id"), F.sum("crc").cast("long").alias("clients_crc"))


def op11_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients at distance at most one from each vendor's misspelt name."""
    vendors = table(spark, sf_dir, "vendors").select("vendor_id", misspelt(F.col("name"), F.col("vendor_id")).alias("name"))
    return join_names(vendors, table(spark, sf_dir, "clients").select("client_id", "name"))


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({}, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda acc, e: xor(xor(acc, e) >> 1, 3988292384 * (xor(acc, e) & 1))), 4294967295)"
_DROP = "left({0}, i - 1) || substr({0}, i + 1)"

#: Over DuckDB's unnest and lambdas; whole-name deletions find the candidates, rules of one edit verify them.
ORACLE = rf"""WITH v0 AS (SELECT DISTINCT vendor_id, name, {_CRC.format("CAST(vendor_id AS VARCHAR)")} AS h FROM vendors WHERE name <> ''),
v1 AS (SELECT vendor_id, name, h, CAST(h % greatest(length(name) - 1, 1) AS BIGINT) + 1 AS p FROM v0),
v AS (SELECT DISTINCT vendor_id, CASE WHEN h % 2 = 0 AND length(name) >= 2
    THEN left(name, p - 1) || substr(name, p + 1, 1) || substr(name, p, 1) || substr(name, p + 2) ELSE name END AS x FROM v1),
c AS (SELECT client_id, name AS y, {_CRC.format("CAST(client_id AS VARCHAR)")} AS crc FROM clients WHERE name <> ''),
vk AS (SELECT DISTINCT vendor_id, x, unnest(list_append(list_transform(range(1, length(x) + 1), lambda i: {_DROP.format("x")}), x)) AS k FROM v),
ck AS (SELECT DISTINCT y, unnest(list_append(list_transform(range(1, length(y) + 1), lambda i: {_DROP.format("y")}), y)) AS k FROM (SELECT DISTINCT y FROM c)),
met AS (SELECT DISTINCT vendor_id, x, y FROM vk JOIN ck USING (k)),
near AS (SELECT vendor_id, y, CASE WHEN x = y THEN 0
    WHEN length(x) = length(y) AND len(list_filter(range(1, length(x) + 1), lambda i: left(x, i - 1) = left(y, i - 1) AND substr(x, i + 1) = substr(y, i + 1))) > 0 THEN 1
    WHEN length(x) = length(y) AND len(list_filter(range(1, length(x)), lambda i: left(x, i - 1) || substr(x, i + 1, 1) || substr(x, i, 1) || substr(x, i + 2) = y)) > 0 THEN 1
    WHEN length(x) = length(y) + 1 AND len(list_filter(range(1, length(x) + 1), lambda i: {_DROP.format("x")} = y)) > 0 THEN 1
    WHEN length(y) = length(x) + 1 AND len(list_filter(range(1, length(y) + 1), lambda i: {_DROP.format("y")} = x)) > 0 THEN 1 END AS distance FROM met)
SELECT vendor_id, CAST(distance AS INT) AS distance, count(*) AS n_clients, min(client_id) AS first_client_id, CAST(sum(crc) AS BIGINT) AS clients_crc
FROM near JOIN c USING (y) WHERE distance IS NOT NULL GROUP BY ALL"""
