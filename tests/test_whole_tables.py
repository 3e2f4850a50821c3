"""Queries over whole tables against brute force, on small tables with ids that the subset queries leave out."""

from collections import defaultdict

from pyspark.sql import functions as F

import __spark_entry__ as entry_points

#: order, customer, day: no customer is a multiple of 10, and no order is below 200
ORDERS = [(1000 + i, 1 + i * i % 7, 1 + i * 5 % 11) for i in range(40)]


def orders(spark, where):
    frame = spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, day int")
    frame.withColumn("o_orderdate", F.expr("make_timestamp_ntz(2024, 1, day, 0, 0, 0)")).drop("day").write.parquet(f"{where}/orders.parquet")
    chains = defaultdict(list)
    for key, customer, _ in sorted(ORDERS, key=lambda o: (o[2], o[0])):
        chains[customer].append(key)
    return chains


def rows(spark, name, where):
    return sorted(tuple(r) for r in entry_points.queries()[name](spark, str(where)).collect())


def test_paths_and_components(spark, tmp_path):
    chains = orders(spark, tmp_path)
    assert rows(spark, "path_plus", tmp_path) == sorted((k, len(c) - i - 1, len(c) - i - 1) for c in chains.values() for i, k in enumerate(c[:-1]))
    assert rows(spark, "path_bounded", tmp_path) == sorted((c[i], ">".join(map(str, c[i : i + n + 1])), n) for c in chains.values() for i in range(len(c)) for n in (1, 2, 3) if i + n < len(c))
    assert rows(spark, "communities_wcc", tmp_path) == sorted((k, len(c) + 1) for k, c in chains.items())


#: partkey, name, brand, type, size: all sizes above 10 and keys above 200; 301 and 303 only link over 302
PARTS = [(301, "small red ring", "B1", "T1", 11), (302, "small red rixy", "B1", "T1", 20), (303, "smazz red rixy", "B1", "T1", 50), (304, "Small Red Ring", "B1", "T1", 12), (305, "small red ring", "B2", "T1", 12), (306, "large blue bolt", "B1", "T1", 30)]


def distance(a, b):
    known = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            known[i][j] = min(known[i - 1][j] + 1, known[i][j - 1] + 1, known[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return known[-1][-1]


def test_links_groups_and_names(spark, tmp_path):
    spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    pairs = []
    for a, n, *block in PARTS:
        for b, m, *other in PARTS:
            if a < b and block[:2] == other[:2] and (s := 1 - distance(n.lower(), m.lower()) / max(len(n), len(m))) >= 0.8:
                pairs.append((a, b, round(s, 9)))
    assert rows(spark, "entity_linking_pairs", tmp_path) == sorted(pairs)
    assert (301, 303) not in {(a, b) for a, b, _ in pairs}
    assert rows(spark, "entity_groups", tmp_path) == [(301, 301), (302, 301), (303, 301), (304, 301), (305, 305), (306, 306)]
    assert rows(spark, "jaccard_names", tmp_path) == [(301, 1.0), (302, 0.5), (303, 0.2), (304, 1.0), (305, 1.0), (306, 0.0)]
