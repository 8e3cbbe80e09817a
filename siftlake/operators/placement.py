"""Placing fragments into files: which tail belongs to which header, where pages and clusters go, what a range of a file
holds, what is missing there and where it could come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.shared import SharedTables


def index_scores(headers: DataFrame, tails: DataFrame) -> DataFrame:
    """(header, tail, score): share of a header's objects (header, number, pos) that a tail's index (tail, number,
    offset) puts where they are; 1 if header and tail are one fragment."""
    n = headers.groupBy("header").agg(F.count_distinct("number", "pos").alias("n"))
    a, b = headers.select("header", "number", F.col("pos").alias("offset")).distinct(), tails.select("tail", "number", "offset").distinct()
    met = a.join(b, ["number", "offset"]).groupBy("header", "tail").agg(F.count(F.lit(1)).alias("hits"))
    scored = met.join(n, "header").select("header", "tail", (F.col("hits") / F.col("n")).alias("score"))
    same = headers.select("header").distinct().join(tails.select(F.col("tail").alias("header")).distinct(), "header").select("header", F.col("header").alias("tail"), F.lit(1.0).alias("own"))
    both = scored.join(same, ["header", "tail"], "full_outer")
    return both.select("header", "tail", F.coalesce("own", "score").alias("score"), F.col("own").isNotNull().alias("same"))


#: Objects of an item whose pairs are found where they meet first; items with more are counted meeting by meeting.
MOST = 64


def _key() -> Column:
    """Number and place of an object in one number, null where they do not fit."""
    return F.when(F.col("number").between(0, 63) & (F.abs("pos") < 1 << 56), F.col("pos") * 64 + F.col("number")).cast("long")


def _odd() -> Column:
    return _key().isNull() & F.col("number").isNotNull() & F.col("pos").isNotNull()


def _with_sets(rows: DataFrame, item: str) -> DataFrame:
    """(item, number, pos, key, n, held): the distinct objects (item, number, pos), with number and place in one key, how
    many the item holds, and all its keys. held is null where they are more than MOST or make no key."""
    w = Window.partitionBy(item)
    o = w.orderBy("number", "pos")
    again = F.lag(item).over(o).isNotNull() & F.lag("number").over(o).eqNullSafe(F.col("number")) & F.lag("pos").over(o).eqNullSafe(F.col("pos"))
    rows = rows.select(item, "number", "pos").withColumn("again", again).where("not again").drop("again")
    rows = rows.withColumns({"key": _key(), "n": F.count(F.lit(1)).over(w), "odd": F.count_if(_odd()).over(w)})
    bounded = (F.col("n") <= MOST) & (F.col("odd") == 0)
    rows = rows.withColumn("held", F.when(bounded, F.collect_list(F.when(bounded, F.col("key"))).over(w)))
    return rows.where("number is not null and pos is not null").drop("odd")


def _has_wide(rows: DataFrame, item: str) -> bool:
    """Whether any item has no bounded set, or might have none."""
    return not rows.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.max(_odd()).alias("odd")).where(f"n > {MOST} or odd").isEmpty()


def _meetings(headers: DataFrame, tails: DataFrame) -> DataFrame:
    """(header, tail, n, hits) of headers and tails (each item, number, pos) with a common object. A pair of bounded sets is
    counted in full at its least common key, so nothing is moved for a pair; others are summed up over all meetings."""
    x, y = _with_sets(headers, "header"), _with_sets(tails, "tail")
    a = x.where("held is not null").select("header", "key", F.col("n").cast("int").alias("n"), F.col("held").alias("a"))
    b = y.where("held is not null").select("tail", "key", F.col("held").alias("b"))
    met = a.join(b, "key").withColumn("both", F.array_intersect("a", "b")).where("array_min(both) = key")
    out = met.select("header", "tail", F.col("n").cast("long").alias("n"), F.size("both").cast("long").alias("hits"))
    wide = [(x.where("held is null"), y)] if _has_wide(headers, "header") else []
    wide += [(x.where("held is not null"), y.where("held is null"))] if _has_wide(tails, "tail") else []
    for one, other in wide:
        met = one.select("header", "number", "pos", "n").join(other.select("tail", "number", "pos"), ["number", "pos"])
        out = out.unionByName(met.groupBy("header", "tail", "n").agg(F.count(F.lit(1)).alias("hits")))
    return out


def all_index_scores(headers: DataFrame, tails: DataFrame) -> DataFrame:
    """What index_scores gives, every pair, without moving the meetings of pairs."""
    between = _meetings(headers, tails.withColumnRenamed("offset", "pos")).where("header <> tail").select("header", "tail", (F.col("hits") / F.col("n")).alias("score"), F.lit(False).alias("same"))
    return between.unionByName(own_tails(headers.select("header").distinct(), tails.select("tail").distinct()).withColumn("same", F.lit(True)))


def index_classes(rows: DataFrame, item: str) -> DataFrame:
    """(item, first, n): the first item with the same set of (number, pos), by a hash of the set, and how many it holds."""
    held = F.array_sort(F.collect_set(F.struct("number", "pos")))
    sets = rows.groupBy(item).agg(held.alias("held")).select(item, F.size("held").alias("n"), F.unhex(F.sha2(F.to_json("held"), 256)).alias("key"))
    return sets.select(item, "n", F.min(item).over(Window.partitionBy("key")).alias("first"))


def index_class_scores(headers: DataFrame, tails: DataFrame, least: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What index_scores gives, between classes: headers with the same objects score alike, and so do tails with the same
    index. (header, tail, score) between the firsts of classes; the members (header, first, n) and (tail, first, n). A
    pair holds for each header and tail of its classes but for a header and itself. Scores under `least` are left out."""
    tables = lambda name, df: SharedTables(df.sparkSession, name).save(df)
    tails = tails.withColumnRenamed("offset", "pos")
    of_header, of_tail = tables("header-classes", index_classes(headers, "header")), tables("tail-classes", index_classes(tails, "tail"))
    a = headers.join(of_header.where("header = first").select("header"), "header", "left_semi")
    b = tails.join(of_tail.where("tail = first").select("tail"), "tail", "left_semi")
    met = _meetings(a, b)
    pairs = met.select("header", "tail", (F.col("hits") / F.col("n")).alias("score")).where(F.col("score") >= least)
    return tables("class-scores", pairs), of_header, of_tail


def own_tails(of_header: DataFrame, of_tail: DataFrame) -> DataFrame:
    """(header, tail, score) of fragments that are header and tail."""
    both = of_header.select("header").join(of_tail.select(F.col("tail").alias("header")), "header")
    return both.select("header", F.col("header").alias("tail"), F.lit(1.0).alias("score"))


def match_in_turn(scores: DataFrame, least: float = 0.5) -> DataFrame:
    """(header, tail, score): each header in order takes the best tail that is left, its own before others."""
    asks = scores.where((F.col("score") >= least) | F.col("same"))
    lists = asks.select(F.col("header").alias("class"), "tail", "score", (~F.col("same")).alias("other"))
    headers = asks.select("header", F.col("header").alias("class")).distinct()
    return _in_turn(lists, headers, asks.select("header", "tail", "score").where("false"))


def match_classes(pairs: DataFrame, of_header: DataFrame, of_tail: DataFrame, least: float = 0.5) -> DataFrame:
    """match_in_turn over what index_class_scores gives: a list of tails is kept once for all headers of a class."""
    members = of_tail.select(F.col("first").alias("tail"), F.col("tail").alias("member"))
    lists = pairs.where(F.col("score") >= least).join(members, "tail").select(F.col("header").alias("class"), F.col("member").alias("tail"), "score", F.lit(True).alias("other"))
    headers = of_header.select("header", F.col("first").alias("class"))
    return _in_turn(lists, headers, own_tails(of_header, of_tail))


def _in_turn(lists: DataFrame, headers: DataFrame, held: DataFrame) -> DataFrame:
    """(header, tail, score). lists: class, tail, score, other; headers: header, class; held: what is held at first, the
    tail that a header likes best (header, tail, score).

    In each round the waiting headers of a class line up with the tails of its list that no earlier header holds, the
    first with the best, and a tail goes to the first header that asks. Whom a tail refuses, also one who held it, waits
    again. A header passes over only tails for which earlier ones of its class ask, so the end is that of taking turns.
    Who finds no tail to ask for is out: earlier headers have asked for all that are left. Rounds are as many as the
    longest run of refusals between classes; the copies of a class take one."""
    tables = {name: SharedTables(lists.sparkSession, f"match-{name}") for name in ("lists", "open", "held", "asks")}
    lists = tables["lists"].save(lists)
    held = tables["held"].save(held)
    open_ = tables["open"].save(headers.join(lists.select("class").distinct(), "class", "left_semi").select("header", "class"))
    best = Window.partitionBy("class").orderBy("other", F.desc("score"), "tail")
    while True:
        waiting = open_.join(held.select("header"), "header", "left_anti")
        sizes = waiting.groupBy("class").agg(F.min("header").alias("one"), F.count(F.lit(1)).alias("size"))
        free = lists.join(sizes, "class").join(held.select("tail", F.col("header").alias("holder")), "tail", "left").where("holder is null or holder > one")
        places = free.withColumn("k", F.row_number().over(best)).where("k <= size").select("class", "k", "tail", "score")
        queue = waiting.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy("header")))
        asks = tables["asks"].save(places.join(queue, ["class", "k"]).select("header", "tail", "score"))
        if not asks.head(1):
            return held
        open_ = tables["open"].save(open_.join(held.select("header").unionByName(asks.select("header")), "header", "left_semi"))
        first = F.min(F.struct("header", "score")).alias("b")
        held = tables["held"].save(held.unionByName(asks).groupBy("tail").agg(first).select("b.header", "tail", "b.score"))


def split_tails(tails: DataFrame, placed: DataFrame) -> DataFrame:
    """(tail, fragment): fragments (fragment, start) that begin where a tail's pointer (tail, pointer) says its index is."""
    return tails.join(placed.withColumnRenamed("start", "pointer"), "pointer").where("tail <> fragment").select("tail", "fragment")


def key_ranges(keys: DataFrame, table: str) -> DataFrame:
    """table, page, low, high: the row ids of each child page of an interior page (table, ord, page, key), where key is
    the greatest one and null for the last child."""
    w = Window.partitionBy(table).orderBy("ord")
    return keys.select(table, "page", F.coalesce(F.lag("key").over(w) + 1, F.lit(1)).alias("low"), F.coalesce("key", F.lit((1 << 63) - 1)).alias("high"))


def place_leaves(leaves: DataFrame, ranges: DataFrame, table: str) -> DataFrame:
    """Leaves (table, leaf, least, most) at the page whose range holds all their row ids: table, leaf, page.

    Ranges of a table do not overlap, so the one with the greatest low end not above a leaf's least row id is the only
    candidate: both sides are sorted once and the last range is carried along."""
    a = ranges.select(table, F.col("low").alias("at"), F.lit(0).alias("side"), F.struct("page", "high").alias("range"), F.lit(None).cast("struct<leaf: bigint, most: bigint>").alias("own"))
    b = leaves.select(table, F.col("least").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(a.schema["range"].dataType).alias("range"), F.struct(F.col("leaf").cast("long").alias("leaf"), F.col("most").cast("long").alias("most")).alias("own"))
    w = Window.partitionBy(table).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = a.unionByName(b).withColumn("held", F.last("range", ignorenulls=True).over(w)).where("own is not null")
    return met.where(F.col("own.most") <= F.col("held.high")).select(table, "own.leaf", "held.page")


def nearest(targets: DataFrame, pool: DataFrame, by: Sequence[str], at: str, item: str) -> DataFrame:
    """Each target with the item of its group nearest in `at`, the smaller value first, then the smaller item: targets'
    columns, item, off. Both sides are sorted up and down, and the last item is carried along each way: a frame that ends
    with its group would be gone through again for every row."""
    keys = list(by)
    kind = dict(pool.dtypes)[item]
    marked = pool.groupBy(*keys, F.col(at).alias("_at")).agg(F.min(item).alias("_i")).withColumn("_t", F.lit(None).cast(f"struct<{', '.join(f'`{c}`: {k}' for c, k in targets.dtypes)}>"))
    asked = targets.select(*keys, F.col(at).alias("_at"), F.lit(None).cast(kind).alias("_i"), F.struct(*targets.columns).alias("_t"))
    rows = marked.unionByName(asked).withColumn("_side", F.col("_t").isNotNull().cast("int"))
    own = F.when(F.col("_i").isNotNull(), F.struct("_at", "_i"))
    up = Window.partitionBy(*keys).orderBy("_at", "_side")
    down = Window.partitionBy(*keys).orderBy(F.col("_at").desc_nulls_last(), F.when(F.col("_at").isNull(), 1 - F.col("_side")).otherwise(F.col("_side")))
    low, high = (F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for w in (up, down))
    met = rows.withColumn("_low", low).withColumn("_high", high).where("_t is not null")
    choice = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}._at") - F.col("_at")).alias("off"), F.col(f"{c}._i").alias("item")))
    best = F.array_min(F.filter(F.array(choice("_low"), choice("_high")), lambda x: x.isNotNull()))
    return met.withColumn("_b", best).select("_t.*", F.col("_b.item").alias(item), F.col("_b.off").alias("off"))


def orphan_entries(orphans: DataFrame, entries: DataFrame, matched: DataFrame, span: int = 40) -> DataFrame:
    """(orphan, entry, confidence): the directory entry (entry, cluster, size, type) that no file was matched with and
    that an orphan (orphan, cluster, type) most likely belongs to: of its type, within 40 times the entry's length. The
    nearer the likelier, 0.55 at most. Entries meet orphans in buckets of clusters as wide as they reach."""
    free = entries.join(matched.select("entry").distinct(), "entry", "left_anti").withColumn("reach", F.ceil(F.col("size") / fixed.CLUSTER) * span)
    width = 1 << 16
    a = free.select("entry", "type", F.col("cluster").alias("c"), "reach", F.explode(F.sequence(F.floor((F.col("cluster") - F.col("reach")) / width), F.floor((F.col("cluster") + F.col("reach")) / width))).alias("bucket"))
    b = orphans.select("orphan", "type", "cluster", F.floor(F.col("cluster") / width).alias("bucket"))
    met = a.join(b, ["type", "bucket"]).withColumn("d", F.abs(F.col("cluster") - F.col("c"))).where((F.col("d") > 0) & (F.col("d") <= F.col("reach")))
    sure = F.least(F.lit(0.55), 0.55 * (1 - F.col("d") / F.col("reach")) + 0.05)
    best = met.groupBy("orphan").agg(F.max(F.struct(sure.alias("sure"), (-F.col("entry")).alias("e"))).alias("b"))
    return best.select("orphan", (-F.col("b.e")).alias("entry"), F.round("b.sure", 6).alias("confidence"))


def range_states(asked: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """asked (key, start, end) with the state of that range: recovered, missing, corrupted, or partial where only some of
    it is missing; and the fragments it comes from. A range that no segment covers is missing. segments: key, start, end,
    kind, fragment."""
    s = segments.select(key, F.col("start").alias("_a"), F.col("end").alias("_b"), "kind", "fragment")
    met = asked.join(s, [key]).where((F.col("_a") < F.col("end")) & (F.col("_b") > F.col("start")))
    kinds = met.groupBy(key, "start", "end").agg(F.collect_set("kind").alias("kinds"), F.array_sort(F.collect_set("fragment")).alias("fragments"))
    has = lambda k: F.array_contains("kinds", k)
    state = F.when(F.col("kinds").isNull() | ((F.size("kinds") == 1) & has("missing")), "missing").when(has("missing"), "partial").when((F.size("kinds") == 1) & has("recovered"), "recovered").otherwise("corrupted")
    return asked.join(kinds, [key, "start", "end"], "left").select(*asked.columns, state.alias("state"), F.coalesce("fragments", F.array().cast("array<string>")).alias("fragments"))


def expected_content(gaps: DataFrame, index: DataFrame, shown: int = 12) -> DataFrame:
    """gaps (file, start, end) with how many indexed objects (file, number, offset) begin there, and the first of them."""
    met = gaps.join(index, "file").where((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end")))
    found = met.groupBy("file", "start", "end").agg(F.count(F.lit(1)).alias("objects"), F.slice(F.array_sort(F.collect_set("number")), 1, shown).alias("first"))
    return gaps.join(found, ["file", "start", "end"], "left").select(*gaps.columns, F.coalesce("objects", F.lit(0)).alias("objects"), "first")


def other_copies(corrupted: DataFrame, fragments: DataFrame) -> DataFrame:
    """corrupted (file, start, fragment) with the fragments that hold the same bytes, either way round. fragments:
    fragment, duplicate_of."""
    pairs = fragments.where("duplicate_of is not null").select("fragment", F.col("duplicate_of").alias("copy"))
    both = pairs.unionByName(pairs.select(F.col("copy").alias("fragment"), F.col("fragment").alias("copy"))).distinct()
    return corrupted.join(both, "fragment").select("file", "start", "fragment", "copy")


def possibility(files: DataFrame, regions: DataFrame) -> DataFrame:
    """file and how far more can be recovered: N/A without damage, UNKNOWN for orphans, LOW for signature stubs, else the
    best level of its regions. files: file, orphan, stub; regions: file, level."""
    order = F.array(*map(F.lit, ("UNKNOWN", "LOW", "MEDIUM", "HIGH")))
    best = regions.groupBy("file").agg(F.max(F.array_position(order, F.col("level"))).cast("int").alias("best"))
    level = F.when(F.col("stub"), "LOW").when(F.col("orphan"), "UNKNOWN").when(F.col("best").isNull(), "N/A").otherwise(F.get(order, F.col("best") - 1))
    return files.join(best, "file", "left").select("file", level.alias("level"))


def provenance(segments: DataFrame, fragments: DataFrame, decisions: DataFrame) -> DataFrame:
    """file and its history: an array of (seq, kind, fragment, family, decisions) in order. decisions: fragment, text."""
    told = decisions.groupBy("fragment").agg(F.array_sort(F.collect_list("text")).alias("decisions"))
    rows = segments.join(fragments.select("fragment", "family"), "fragment", "left").join(told, "fragment", "left")
    item = F.struct("seq", "kind", "fragment", "family", F.coalesce("decisions", F.array().cast("array<string>")).alias("decisions"))
    return rows.groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("history"))


def joins_in_order(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Each segment with the one that follows it in its file, and the accepted link between their fragments: file, seq,
    src, dst, confidence, decision. A join without a recorded link is explained by the layout."""
    w = Window.partitionBy("file").orderBy("seq")
    steps = segments.select("file", "seq", F.col("fragment").alias("src"), F.lead("fragment").over(w).alias("dst")).where("dst is not null")
    links = edges.where("chosen").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    text = F.when(F.col("confidence").isNull(), "placed by the file's own layout").otherwise(F.format_string("link %s to %s at %.0f%%", "src", "dst", 100 * F.col("confidence")))
    return steps.join(links, ["src", "dst"], "left").select("file", "seq", "src", "dst", "confidence", text.alias("decision"))


def coalesce_segments(segments: DataFrame, file: str) -> DataFrame:
    """Neighbouring segments (file, start, end, fragment, source) that go on in both places become one. A run is its first
    row with the end of its last, which comes next when the rows between are left out; no run is a group of its own."""
    w = Window.partitionBy(file).orderBy("start")
    lag = lambda c: F.lag(c).over(w)
    new = ~F.coalesce((lag("end") == F.col("start")) & lag("fragment").eqNullSafe(F.col("fragment")) & ((F.col("source") - lag("source")).eqNullSafe(F.col("start") - lag("start"))), F.lit(False))
    rows = segments.withColumn("_new", new)
    ends = rows.withColumn("_last", F.coalesce(F.lead("_new").over(w), F.lit(True))).where("_new or _last")
    # a last segment that ends before it starts ends its run where it starts
    until = F.when(F.col("_last"), F.col("end")).otherwise(F.greatest(F.lead("start").over(w), F.lead("end").over(w)))
    return ends.withColumn("end", until).where("_new").select(file, "start", "end", "fragment", "source")


def junctions(segments: DataFrame, owners: DataFrame, cluster: int = fixed.CLUSTER) -> DataFrame:
    """Joins of consecutive segments (file, start, length, source) that lie apart on the image, each with whether the truth
    (cluster, name, logical) has the two clusters one after another in one file: file, last, first, correct."""
    w = Window.partitionBy("file").orderBy("start")
    end = F.col("start") + F.col("length")
    steps = segments.where("source is not null").select("file", "start", F.floor((F.col("source") + F.col("length") - 1) / cluster).alias("last"), F.floor(F.lead("source").over(w) / cluster).alias("first"), (F.lead("start").over(w) == end).alias("next"))
    steps = steps.where(F.col("next") & ~F.col("first").isin(F.col("last"), F.col("last") + 1))
    a = owners.select(F.col("cluster").alias("last"), F.col("name").alias("na"), F.col("logical").alias("la"))
    b = owners.select(F.col("cluster").alias("first"), F.col("name").alias("nb"), F.col("logical").alias("lb"))
    met = steps.join(a, "last", "left").join(b, "first", "left")
    return met.select("file", "last", "first", F.coalesce((F.col("na") == F.col("nb")) & (F.col("lb") == F.col("la") + 1), F.lit(False)).alias("correct"))


def capped_chain(parts: DataFrame, chain: str, order: str, length: str, listed: str) -> DataFrame:
    """Parts of a chain in order with the bytes of each that count: a size listed in a directory ends the file."""
    before = Window.partitionBy(chain).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(length).over(before), F.lit(0))
    used = F.when(F.col(listed).isNull(), F.col(length)).otherwise(F.greatest(F.lit(0), F.least(F.col(length), F.col(listed) - at)))
    return parts.withColumn("at", at).withColumn("used", used).where("used > 0")


def materialise(placed: DataFrame, sizes: DataFrame, cluster: int = fixed.CLUSTER) -> DataFrame:
    """file, data: clusters (file, logical, data) put together, zeros where one is missing, cut to the file's size
    (file, size). A file is one value, as it is written out."""
    slots = sizes.select("file", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / cluster) - 1, F.lit(0)))).alias("logical"))
    rows = slots.join(placed, ["file", "logical"], "left").withColumn("part", F.coalesce(F.hex("data"), F.lit("00" * cluster)))
    joined = rows.groupBy("file", "size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("logical", "part"))), lambda x: x["part"]), "").alias("digits"))
    return joined.select("file", F.unhex(F.substring("digits", F.lit(1), (2 * F.col("size")).cast("int"))).alias("data"))


def straddling_restarts(clusters: DataFrame, image: str) -> DataFrame:
    """Restart markers cut by a cluster's end: image, cluster (the one that ends in FF), number. clusters: image, cluster,
    data. Neighbours meet by cluster number, no order of all clusters is needed."""
    head = lambda i, n: F.hex(F.substring("data", i, n))
    ends = clusters.where(F.hex(F.substring("data", -1, 1)) == "FF").select(image, "cluster")
    starts = clusters.where(F.rlike(head(1, 1), F.lit("^D[0-7]$"))).select(image, (F.col("cluster") - 1).alias("cluster"), (F.conv(head(1, 1), 16, 10).cast("int") - 0xD0).alias("number"))
    return ends.join(starts, [image, "cluster"])


def text_continuity(tail: Column, head: Column) -> Column:
    """How well two pieces of prose go on: both or neither in the midst of a sentence."""
    stripped = F.rtrim(tail, F.lit("\0"))
    middle = (F.length(stripped) > 0) & ~F.right(stripped, F.lit(1)).isin("\n", ".")
    goes_on = (F.length(head) > 0) & ~F.rlike(head, F.lit("^[A-Z]"))
    return F.when(middle == goes_on, 0.6).otherwise(0.3)


def free_fragments(fragments: DataFrame, claimed: DataFrame, families: Sequence[str] = ()) -> DataFrame:
    """Fragments (fragment, family, duplicate_of) that nothing claims and that are no copies, of the families given."""
    out = fragments.where("duplicate_of is null")
    if families:
        out = out.where(F.col("family").isin(*families))
    return out.join(claimed.select("fragment").distinct(), "fragment", "left_anti")


def training_pairs(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """Scored pairs of clusters (src, dst, type) with their label by the truth (cluster, name, logical): a continuation
    must be the next cluster of the same file, a structural link a later one."""
    a = owners.select(F.col("cluster").alias("src"), F.col("name").alias("na"), F.col("logical").alias("la"))
    b = owners.select(F.col("cluster").alias("dst"), F.col("name").alias("nb"), F.col("logical").alias("lb"))
    met = pairs.join(a, "src").join(b, "dst")
    same = F.col("na") == F.col("nb")
    right = F.when(F.col("type") == "continuation", same & (F.col("lb") == F.col("la") + 1)).otherwise(same & (F.col("lb") > F.col("la")))
    return met.select(*pairs.columns, right.cast("int").alias("label"))
