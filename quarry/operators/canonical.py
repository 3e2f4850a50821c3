"""Names of blank nodes that depend on a graph's structure alone, and hashes of graphs that renaming does not change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.terms import nt
from quarry.operators.closure import weak_components
from quarry.operators.ledger import graph_hash
from quarry.operators.stage import stored

#: Ways of telling tied nodes of one component apart that are followed at a time; a graph that needs more has no hash.
MOST_BRANCHES = 4096


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def _bag(col: Column) -> list[Column]:
    """Aggregates that tell bags of SHA-256 texts apart, in any order and without gathering them: sums of four parts."""
    return [F.sum(F.conv(F.substring(col, at, 15), 16, 10).cast("decimal(19,0)")).alias(f"part{k}") for k, at in enumerate((1, 16, 31, 46))]


def _parts() -> Column:
    return F.concat_ws(",", *[F.coalesce(F.col(f"part{k}").cast("string"), F.lit("0")) for k in range(4)])


def _ends(quads: DataFrame) -> DataFrame:
    """n, sig, other: of each blank node what it takes part in, and the blank node at the other end, if it is one."""
    graph = F.coalesce(F.concat(F.lit("<"), F.col("g"), F.lit(">")), F.lit("DEFAULT"))
    s_blank, o_blank, loop = F.col("s_kind") == "bnode", F.col("o_kind") == "bnode", F.col("s") == F.col("o")
    q = quads.select(graph.alias("graph"), "s", "p", "o", s_blank.alias("sb"), o_blank.alias("ob"), nt("s", "s_kind").alias("s_nt"), nt("o", "o_kind", "o_dt", "o_lang").alias("o_nt")).distinct()
    node = lambda c: F.concat_ws("\n", "graph", c)
    as_s = q.where("sb").select(node("s").alias("n"), F.concat(F.lit("s|"), "p", F.lit("|"), F.when(~F.col("ob"), F.col("o_nt")).when(loop, "@self").otherwise("")).alias("sig"), F.when(F.col("ob") & ~loop, node("o")).alias("other"))
    as_o = q.where(F.col("ob") & ~(F.col("sb") & loop)).select(node("o").alias("n"), F.concat(F.lit("o|"), "p", F.lit("|"), F.when(~F.col("sb"), F.col("s_nt")).otherwise("")).alias("sig"), F.when(F.col("sb"), node("s")).alias("other"))
    return as_s.unionByName(as_o)


def _counted(colors: DataFrame) -> DataFrame:
    """colors (u, br, n, c) with k, the different colors of a branch of a component, and size, its nodes."""
    by = colors.groupBy("u", "br", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("u", "br").agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("size"))
    return colors.select("u", "br", "n", "c").join(by, ["u", "br"])


def _refined(links: DataFrame, colors: DataFrame) -> DataFrame:
    """colors once each branch is stable: a node's color takes in those at the other ends until no color splits any more."""
    now, done = stored(_counted(colors)), None
    while True:
        settled = now.where("k = size") if done is None else now.where("k = size or k = was")
        done = settled.select("u", "br", "n", "c", "k", "size") if done is None else done.unionByName(settled.select("u", "br", "n", "c", "k", "size"))
        now = now.where("k < size") if "was" not in now.columns else now.where("k < size and k > was")
        if now.isEmpty():
            return stored(done)
        far = now.select("u", "br", F.col("n").alias("other"), F.col("c").alias("far"))
        met = links.join(far, ["u", "other"]).groupBy("u", "br", "n").agg(*_bag(_sha(F.col("sig"), F.col("far"))))
        nearer = now.select("u", "br", "n", "c", "k").join(met, ["u", "br", "n"], "left").select("u", "br", "n", _sha(F.col("c"), _parts()).alias("c"), F.col("k").alias("was"))
        now = stored(_counted(nearer).join(nearer.select("u", "br", "was").distinct(), ["u", "br"]))


def _told_apart(links: DataFrame, stable: DataFrame) -> DataFrame:
    """Branches of stable colorings with ties, some nodes of a tied color told apart.

    Twins are nodes of a color that can change places: the same ends, and to each
    other either none or all. Any order of them gives the same graph, so they are
    all told apart at once. Colors whose nodes are all twins need no choice; where
    there are none of those, each lot of twins of the smallest color makes a branch.
    """
    tied = stable.where("k < size")
    classes = tied.groupBy("u", "br", "c").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    member = tied.join(classes, ["u", "br", "c"]).select("u", "br", "c", "n", "m")
    far = member.select("u", "br", F.col("n").alias("other"), F.col("c").alias("far"))
    near = member.join(links, ["u", "n"]).join(far, ["u", "br", "other"], "left").withColumn("within", F.coalesce(F.col("far") == F.col("c"), F.lit(False)))
    near = near.withColumn("all_within", F.sum(F.col("within").cast("int")).over(W.partitionBy("u", "br", "n", "sig")) == F.col("m") - 1)
    token = F.when(F.col("within") & F.col("all_within"), _sha(F.col("sig"), F.lit("@class"))).otherwise(_sha(F.col("sig"), F.col("other")))
    ends = near.groupBy("u", "br", "c", "m", "n").agg(*_bag(token)).select("u", "br", "c", "m", "n", _parts().alias("ends"))
    lot = W.partitionBy("u", "br", "c", "ends")
    twins = ends.withColumns({"one": F.min("n").over(lot), "place": F.row_number().over(lot.orderBy("n"))})
    lots = twins.groupBy("u", "br", "c", "m").agg(F.count(F.when(F.col("place") == 1, 1)).alias("lots"))
    ways = lots.groupBy("u", "br").agg(F.min(F.struct("lots", "m", "c")).alias("x")).select("u", "br", F.col("x.lots").alias("least"), F.col("x.c").alias("of"))
    taken = twins.join(lots, ["u", "br", "c", "m"]).join(ways, ["u", "br"]).where((F.col("lots") == 1) | ((F.col("least") > 1) & (F.col("c") == F.col("of"))))
    branch = F.when(F.col("least") > 1, F.col("one")).otherwise("").alias("way")
    taken = stored(taken.select("u", "br", branch, "n", "place"))
    rows = tied.select("u", "br", "n", "c").join(taken.select("u", "br", "way").distinct(), ["u", "br"]).join(taken, ["u", "br", "way", "n"], "left")
    return rows.select("u", F.when(F.col("way") == "", F.col("br")).otherwise(F.concat_ws("\t", "br", "way")).alias("br"), "n", F.when(F.col("place").isNotNull(), _sha(F.col("c"), F.lit("!"), F.col("place"))).otherwise(F.col("c")).alias("c"))


def _least(colors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each component the branches whose bag of colors is the smallest, with it as form; and the components with too many of those.

    Where all colors differ, equal bags are the same graph: one branch is kept.
    """
    form = colors.groupBy("u", "br", "k", "size").agg(*_bag(F.col("c"))).select("u", "br", "k", "size", _sha(_parts()).alias("form"))
    best = form.join(form.groupBy("u").agg(F.min("form").alias("form")), ["u", "form"])
    one = best.where("k = size").groupBy("u", "form").agg(F.min("br").alias("br")).unionByName(best.where("k < size").select("u", "form", "br"))
    many = best.where("k < size").groupBy("u").agg(F.count(F.lit(1)).alias("branches")).where(F.col("branches") > MOST_BRANCHES).select("u")
    return stored(colors.join(one, ["u", "br"])), stored(many)


def canonical_labels(quads: DataFrame) -> DataFrame:
    """n (graph and blank node, by a line end), u (its component), form, c: equal for nodes that a renaming maps to each other.

    quads: g, s, s_kind, p, o, o_kind, o_dt, o_lang. Colors of the blank nodes of
    each component that hang together are refined by what they take part in;
    nodes that stay tied are told apart one after another, and of all ways the
    one with the smallest colors counts. form and c are null for components
    that need more than MOST_BRANCHES ways at a time, as the standard lets
    implementations give such graphs up.
    """
    ends = stored(_ends(quads))
    parts = weak_components(ends.where("other is not null").select(F.col("n").alias("src"), F.col("other").alias("dst")))
    nodes = ends.groupBy("n").agg(*_bag(F.when(F.col("other").isNull(), F.sha2("sig", 256)))).join(parts, F.col("n") == F.col("node"), "left")
    colors = nodes.select(F.coalesce("component", "n").alias("u"), F.lit("").alias("br"), "n", _sha(_parts()).alias("c"))
    links = stored(ends.where("other is not null").join(parts, F.col("n") == F.col("node")).select(F.col("component").alias("u"), "n", "sig", "other"))
    found, given_up = None, None
    now = colors
    while True:
        best, many = _least(_refined(links, now))
        given_up = many if given_up is None else given_up.unionByName(many)
        whole = best.where("k = size").select("u", "n", "form", "c")
        found = whole if found is None else found.unionByName(whole)
        open_ = best.where("k < size").join(many, "u", "left_anti")
        if open_.isEmpty():
            break
        now = _told_apart(links, open_)
    lost = colors.join(given_up, "u", "left_semi").select("u", "n", F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("c"))
    return found.unionByName(lost)


def canonical_quads(quads: DataFrame) -> DataFrame:
    """g, line, sound: the N-Triples lines of each named graph with blank nodes called c14n0, c14n1 and so on.

    The numbers go by component (equal ones after each other) and color. sound is
    false for a line with a node of a component that was given up.
    """
    rows = quads.where("g is not null").select("g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang").distinct()
    labels = canonical_labels(rows).withColumn("g", F.regexp_extract("n", r"^<(.*)>\n", 1)).withColumn("b", F.regexp_replace("n", r"^[^\n]*\n", ""))
    number = F.row_number().over(W.partitionBy("g").orderBy("form", "u", "c")) - 1
    labels = stored(labels.select("g", "b", F.when(F.col("c").isNotNull(), F.concat(F.lit("_:c14n"), number.cast("string"))).alias("label")))
    side = lambda end: labels.select("g", F.col("b").alias(end), F.lit("bnode").alias(f"{end}_kind"), F.col("label").alias(f"{end}_label"))
    named = rows.join(side("s"), ["g", "s", "s_kind"], "left").join(side("o"), ["g", "o", "o_kind"], "left")
    s = F.when(F.col("s_kind") == "bnode", F.col("s_label")).otherwise(nt("s", "s_kind"))
    o = F.when(F.col("o_kind") == "bnode", F.col("o_label")).otherwise(nt("o", "o_kind", "o_dt", "o_lang"))
    return named.select("g", F.concat_ws(" ", F.coalesce(s, F.lit("_:")), F.concat(F.lit("<"), "p", F.lit(">")), F.coalesce(o, F.lit("_:")), F.lit(".")).alias("line"), (s.isNotNull() & o.isNotNull()).alias("sound"))


def representatives(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """g, of: of each named graph one that is the same but for the names of blank nodes; and the quads of the latter alone.

    Blank nodes are numbered by what each takes part in and, where that ties, by
    name; graphs whose lines then are the same texts are the same graph. Others
    may be the same too, which is left to the canonical names. Quads are
    shuffled once, by graph. A graph's lines are gathered in one row, so graphs
    should be of block size.
    """
    terms = ("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")
    rows = quads.where("g is not null").select("g", *terms).repartition("g").distinct()
    blank = lambda side: F.col(f"{side}_kind").eqNullSafe("bnode")
    s_nt, o_nt = F.when(~blank("s"), nt("s", "s_kind")), F.when(~blank("o"), nt("o", "o_kind", "o_dt", "o_lang"))
    rows = rows.select("g", *terms, s_nt.alias("s_nt"), o_nt.alias("o_nt"))
    end = lambda side, other: F.struct(F.lit(side).alias("side"), F.when(blank(side), F.col(side)).alias("b"), F.xxhash64(F.lit(side), "p", other).alias("sig"))
    ends = rows.select("*", F.explode(F.array(end("s", "o_nt"), end("o", "s_nt"))).alias("end")).select("*", "end.*").drop("end")
    color = F.sum(F.pmod("sig", F.lit(1 << 31))).over(W.partitionBy("g", "b"))
    number = F.dense_rank().over(W.partitionBy("g").orderBy("color", "b"))
    of = lambda side: F.max(F.when((F.col("side") == side) & F.col("b").isNotNull(), F.col("number")))
    numbered = ends.withColumn("color", color).withColumn("number", number).groupBy("g", *terms, "s_nt", "o_nt").agg(of("s").alias("s_number"), of("o").alias("o_number"))
    node = lambda text, number: F.coalesce(text, F.concat(F.lit("_:"), F.col(number).cast("string")), F.lit(""))
    line = F.concat_ws(" ", node(F.col("s_nt"), "s_number"), F.concat(F.lit("<"), "p", F.lit(">")), node(F.col("o_nt"), "o_number"))
    forms = stored(numbered.groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("form")))
    first = stored(forms.groupBy("form").agg(F.min("g").alias("of")))
    return forms.join(first, "form").select("g", "of"), quads.join(first.select(F.col("of").alias("g")), "g", "left_semi")


def canonical_hash(quads: DataFrame) -> DataFrame:
    """g, hash: SHA-256 of the sorted canonical lines of each named graph; null where a component was given up.

    Graphs that differ in the names of blank nodes only have one hash, others
    have different ones. Of graphs that are plainly the same only one is named.
    A graph is hashed in one row, so graphs should be of block size.
    """
    same, kept = representatives(quads)
    return same.join(_hashed(kept).withColumnRenamed("g", "of"), "of").select("g", "hash")


def _hashed(quads: DataFrame) -> DataFrame:
    """canonical_hash() of every graph for itself."""
    lines = canonical_quads(quads).groupBy("g").agg(F.min("sound").alias("sound"), F.sha2(F.array_join(F.array_sort(F.collect_set("line")), "\n"), 256).alias("hash"))
    return lines.select("g", F.when(F.col("sound"), F.col("hash")).alias("hash"))


def complexity(quads: DataFrame) -> DataFrame:
    """g, triples, blanks, most, complexity: how hard a graph's blank nodes are to name, by their number, its size and how they hang together."""
    q = quads.select("g", "s", "s_kind", "p", "o", "o_kind").distinct()
    s_blank, o_blank = F.col("s_kind") == "bnode", F.col("o_kind") == "bnode"
    size = q.groupBy("g").agg(F.count(F.lit(1)).alias("triples"))
    nodes = q.where(s_blank).select("g", F.col("s").alias("b")).unionByName(q.where(o_blank).select("g", F.col("o").alias("b"))).distinct()
    links = q.where(s_blank & o_blank)
    links = links.select("g", F.col("s").alias("b"), F.col("o").alias("c")).unionByName(links.select("g", F.col("o").alias("b"), F.col("s").alias("c"))).distinct()
    each = nodes.join(links.groupBy("g", "b").agg(F.count(F.lit(1)).alias("links")), ["g", "b"], "left").groupBy("g").agg(F.count(F.lit(1)).alias("blanks"), F.max(F.coalesce("links", F.lit(0))).alias("most"), F.sum(F.coalesce("links", F.lit(0))).alias("all_links"))
    c = size.join(each, "g", "left").select("g", "triples", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("blanks", "most", "all_links")])
    few, some = (F.col("blanks") <= 3) & (F.col("triples") <= 50), (F.col("blanks") <= 10) & (F.col("triples") <= 200)
    mean = F.col("all_links") / F.nullif("blanks", F.lit(0))
    kind = F.when(F.col("blanks") == 0, "Simple").when(few & (F.col("most") <= 1), "Simple").when(few & (F.col("most") <= 2), "Moderate").when(some & (mean <= 1.5) & (F.col("most") <= 2), "Moderate").when(some & ((mean <= 3.0) | (F.col("most") > 2)), "Complex").otherwise("Pathological")
    return c.select("g", "triples", "blanks", "most", kind.alias("complexity"))


def adaptive_hash(quads: DataFrame) -> DataFrame:
    """g, complexity, method, hash: simple and moderate graphs by the hash without names, complex and pathological ones by canonical names."""
    same, named = representatives(quads)
    named = stored(named)
    kinds = stored(complexity(named).select("g", "complexity"))
    hard = kinds.where(F.col("complexity").isin("Complex", "Pathological")).select("g")
    custom = graph_hash(named.join(hard, "g", "left_anti")).withColumn("method", F.lit("custom"))
    canonical = _hashed(named.join(hard, "g", "left_semi")).withColumn("method", F.lit("canonical"))
    hashes = kinds.join(custom.unionByName(canonical), "g").withColumnRenamed("g", "of")
    return same.join(hashes, "of").select("g", "complexity", "method", "hash")
