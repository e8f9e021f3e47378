"""Near duplicates: fast similarity sketches, banding, exact verification, components.

*Sketch.* A document's set is its distinct word shingles. In round i every shingle throws
itself into one of the sketch's bins with a hashed value i + [0, 1); a bin keeps its least.
Rounds go on until every bin is filled; after as many rounds as there are bins each further
round fills one given bin, so two times ``bins`` rounds always suffice. Two sketches agree
in a bin with a chance of the sets' Jaccard similarity, concentrated as if the bins were
independent.

*Banding.* With 160 bins in 32 bands of 5, a pair of similarity 0.8 misses every band with
a chance of (1 - 0.8^5)^32, about 3 in a million; higher similarities with less.

*Verification.* Documents with equal word sequences (told by a cryptographic digest of all
their words) are one class; its smallest id stands for it. In every bucket the smallest
member leads and is compared in full with all others: a row for each member. Links are
confirmed on the words of both texts, numbered by a dictionary of the pair; hashes of words
choose sketches and candidates only.

*What no leader connects.* Members of buckets that still hold several components form groups
(members that buckets connect). All pairs of a group are decided by an exact prefix join on
differences: each set is replaced by its symmetric difference with one central set of its
group, which keeps all distances. A pair of similarity ``percent`` differs in at most
D = (100 - percent) / (100 + percent) of the sum of its sizes. So two members either lie so near
to the centre that the sum of their differences is at most D, and then both are linked to
the member nearest to it; or their differences have at least half of what goes beyond D in
common. Then, with the rarest elements first, each has one of the common elements among
its first few, and meets the other there. Near copies whose edits are their own have
nothing in common but what both lack, so hardly any pair that isn't linked ever meets; the
lists are split by distance, too, and left out where only one component meets. What meets
is compared in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import shared
from panelspark.llm.shared import discard, join_to_one, map_batches, materialise, text_or_empty, unused_name

BINS, BAND = 160, 5
HOT_PAIRS = 2_000  # pairs of one leader beyond which they are salted
SALTS = 64
GROUP_ROWS = 512  # members of a group that one copy of its centre meets
COMMON = 16  # elements in a share of 1/COMMON of a group's differences are ordered by how many hold them
STEP = 1.3  # from one level of distance to the next
_BLOCK = 500_000


def shingle_sets(values, offsets, words: int):
    """The distinct shingle hashes of every text, one after another, and how many each text has."""
    import numpy as np

    from panelspark.llm.bytehash import U, mix, word_hashes

    hashes, per_text = word_hashes(values, offsets)
    sets, counts = [], np.zeros(len(per_text), np.int64)
    steps = [hashes]  # of one, two, ... words from each place
    for i in range(1, words):
        left = steps[-1][: max(0, len(hashes) - i)]
        steps.append(mix(left * U(0x9E3779B97F4A7C15) + hashes[i : i + len(left)] + U(i)))
    at = 0
    for t, n in enumerate(per_text):
        if n:
            found = np.unique(steps[words - 1][at : at + n - words + 1]) if n >= words else steps[n - 1][at : at + 1]
            sets.append(found)
            counts[t] = len(found)
        at += n
    return (np.concatenate(sets) if sets else np.zeros(0, U)), counts


def sketches(elements, counts, bins: int = BINS):
    """Fast similarity sketches of the sets, a row of ``bins`` values each; sets must not be empty."""
    import numpy as np

    from panelspark.llm.bytehash import U, mix, seeds

    n = len(counts)
    out = np.full((n, bins), np.iinfo(np.uint64).max, dtype=U)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), counts)
    salt = seeds(2 * bins, 5_000_000)
    for i in range(2 * bins):
        thrown = mix(elements ^ salt[i])
        value = (thrown & U(0xFFFFFFFF)) | (U(i) << U(32))
        bin_ = (thrown >> U(32)) % U(bins) if i < bins else np.full(len(elements), i - bins, dtype=U)
        np.minimum.at(flat, owner * bins + bin_.astype(np.int64), value)
        open_ = (out == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.any():
            break
        if not open_[owner].all():
            stay = open_[owner]
            elements, owner = elements[stay], owner[stay]
    return out


def _blocks(batches):
    """(batch, first row, last row, bytes, offsets) of runs of about _BLOCK bytes."""
    from panelspark.llm.bytehash import byte_runs, string_bytes

    for batch in batches:
        values, offsets = string_bytes(batch.column("text"))
        for i, j in byte_runs(batch.column("text"), _BLOCK):
            yield batch, i, j, values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _sketch_rows(words: int):
    def run(batches):
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa

        from panelspark.llm.bytehash import U, mix, word_sequences

        for batch, i, j, values, offsets in _blocks(batches):
            elements, counts = shingle_sets(values, offsets, words)
            full = counts > 0
            digests = b"".join(blake2b(x, digest_size=16).digest() for x in word_sequences(values, offsets))
            digests = np.frombuffer(digests, "<i8").reshape(-1, 2)
            bands = [None] * len(counts)
            if full.any():
                rows = sketches(elements, counts[full])
                keys = rows[:, 0::BAND].copy()
                for r in range(1, BAND):
                    keys = mix(keys * U(0x9E3779B97F4A7C15) + rows[:, r::BAND])
                for t, x in zip(np.flatnonzero(full), mix(keys).view(np.int64), strict=True):
                    bands[t] = x
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i),
                    pa.array(counts),
                    pa.array(digests[:, 0].copy()),
                    pa.array(digests[:, 1].copy()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "sig1", "sig2", "bands"],
            )

    return run


def _set_rows(words: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch, i, j, values, offsets in _blocks(batches):
            elements, counts = shingle_sets(values, offsets, words)
            places = np.r_[0, np.cumsum(counts)].astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(places), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(i, j - i), sets], names=["rep", "shingles"])

    return run


def linked(a: bytes, b: bytes, words: int, percent: int) -> bool:
    """Whether the shingle sets of two texts are similar enough, by their words and no hash."""
    import numpy as np

    numbers: dict[bytes, int] = {}
    x, y = (np.array([numbers.setdefault(w, len(numbers)) for w in t.lower().split()], np.int64) for t in (a, b))
    if min(len(x), len(y)) < words:  # a short text's one element is its whole sequence
        return len(x) == len(y) > 0 and bool((x == y).all())
    known = most = max(len(numbers), 2)
    u, v = x, y
    for i in range(1, words):
        if most > (1 << 62) // known:  # number the shingles so far
            found, place = np.unique(np.concatenate([u, v]), return_inverse=True)
            u, v, most = place[: len(u)], place[len(u) :], len(found)
        u, v = u[: len(x) - i] * known + x[i:], v[: len(y) - i] * known + y[i:]
        most *= known
    u, v = np.unique(u), np.unique(v)
    same = len(np.intersect1d(u, v, assume_unique=True))
    return 100 * same >= percent * (len(u) + len(v) - same)


def _confirm(words: int, percent: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a", "b")]
            texts = [batch.column(c) for c in ("of_a", "of_b")]
            kept = [i for i in range(batch.num_rows) if linked(*(t[i].as_py() for t in texts), words, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in kept], pa.int64()) for c in columns], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts`` has rep and text."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.count()
    hot = counts.where((F.col("n") > HOT_PAIRS) & (F.col("n") * 1000 >= total)).select("a", F.lit(True).alias("hot"))
    salted = pairs.join(F.broadcast(hot), "a", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(F.lit(0))
    )
    data = F.col("text").cast("binary")
    first = (
        texts.select(F.col("rep").alias("a"), data.alias("of_a"))
        .join(F.broadcast(hot), "a", "left")
        .withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        .drop("hot")
    )
    second = texts.select(F.col("rep").alias("b"), data.alias("of_b"))
    both = salted.drop("hot").join(first, ["a", "salt"]).join(second, "b")
    return map_batches(both.select("a", "b", "of_a", "of_b"), _confirm(words, percent), "a long, b long").distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node and component, the smallest node that it reaches; ``edges`` has columns a and b.

    Of the edges' nodes and those of ``nodes``. Labels that changed spread along edges, and all jump to the label
    of their label, until none changes. Nodes with many edges, and labels whose nodes have many, are
    joined by broadcast: those that hold a thousandth of all edges are a few thousand at most.
    """
    both = edges.where("a <> b").select("a", "b")
    both = materialise(both.union(both.select("b", "a")).distinct(), "component-edges")
    degrees = both.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    every = degrees if nodes is None else nodes.select("node").distinct().join(degrees, "node", "full")
    start = every.select("node", F.col("node").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
    labels = materialise(start.withColumn("moved", F.lit(True)), "components")
    total = both.count()

    def met(rows: DataFrame, one: DataFrame, key: str, hot: list[int]) -> DataFrame:
        if not hot:
            return rows.join(one, key)
        few = F.broadcast(one.where(F.col(key).isin(hot)))
        return rows.where(F.col(key).isin(hot)).join(few, key).unionByName(rows.where(~F.col(key).isin(hot)).join(one, key))

    many = (F.col("degree") > shared.HOT_ROWS) & (F.col("degree") * shared.HOT_SHARE >= total)
    hot_nodes = [r["node"] for r in labels.where(many).select("node").collect()]
    while not labels.where("moved").isEmpty():
        mass = labels.groupBy("component").agg(F.sum(F.col("degree") + 1).alias("degree"))
        hot_labels = [r["component"] for r in mass.where(many).select("component").collect()]
        # a neighbour whose label stayed has been met with it before
        near = met(both, labels.where("moved").select(F.col("node").alias("b"), "component"), "b", hot_nodes)
        least = labels.select("node", F.col("component").alias("was"), "component", "degree").unionByName(
            near.select(F.col("a").alias("node"), "component"), allowMissingColumns=True
        )
        least = least.groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was"), F.max("degree").alias("degree"))
        of = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = met(least, of, "component", hot_labels)
        component = F.least("component", "further")
        after = materialise(jumped.select("node", component.alias("component"), "degree", (component != F.col("was")).alias("moved")), "components")
        discard(labels)
        labels = after
    discard(both)
    return labels.select("node", "component")


def _prefix_rows(percent: int):
    """For each member and level of distance: the first of its differences, one of which it must
    share with a member of that level to be linked to it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            get = {c: batch.column(c) for c in batch.schema.names}
            groups, owns, components, scores = (get[c].to_pylist() for c in ("group", "level", "component", "score"))
            group, levels, of_group = None, [], None
            out: list[list] = [[] for _ in range(4)]  # row, tokens, low level, high level
            places = []
            for r in range(batch.num_rows):
                if groups[r] != group:
                    group, levels = groups[r], get["levels"][r].as_py()
                    held = get["common"][r].values
                    tokens, counts = (held.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(tokens)
                    of_group = tokens[order], counts[order]
                own, component, score = owns[r], components[r], scores[r]
                diff = get["diff"][r].values.to_numpy()
                count = np.zeros(len(diff), np.int64)
                if len(of_group[0]) and len(diff):
                    at = np.minimum(np.searchsorted(of_group[0], diff), len(of_group[0]) - 1)
                    count = np.where(of_group[0][at] == diff, of_group[1][at], 0)
                diff = diff[np.lexsort((diff, count))]
                for x in levels:
                    if x["c0"] == x["c1"] == component:
                        continue
                    common = max(1, -(-(score + x["least"]) // (2 * (100 + percent))))
                    if common <= min(len(diff), x["widest"]):
                        first = diff[: len(diff) - common + 1]
                        out[0].append(np.full(len(first), r))
                        out[1].append(first)
                        out[2].append(np.full(len(first), min(own, x["level"]), np.int32))
                        out[3].append(np.full(len(first), max(own, x["level"]), np.int32))
                        places.append(np.arange(len(first), dtype=np.int32))
            if out[0]:
                rows = np.concatenate(out[0])
                for at in range(0, len(rows), 100_000):
                    part = pa.array(rows[at : at + 100_000])
                    columns = [get[c].take(part) for c in ("group", "rep", "component", "n", "d", "level", "score")]
                    columns += [pa.array(np.concatenate(x)[at : at + 100_000]) for x in (*out[1:], places)]
                    names = ["group", "rep", "component", "n", "d", "level", "score", "token", "low", "high", "place"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _unmet_pairs(open_: DataFrame, sets: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among which are all links that members of the open buckets may have."""
    above, below = 100 + percent, 100 - percent
    firsts = open_.groupBy("band", "h").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("members"))
    met = materialise(join_to_one(open_, firsts, ["band", "h"]), "near-open-buckets")
    weights = met.groupBy("rep").agg(F.sum("members").alias("weight"))
    edges = met.where("first <> rep").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    groups = connected_components(edges, weights.select(F.col("rep").alias("node")))
    groups = groups.select(F.col("node").alias("rep"), F.col("component").alias("group"))

    placed = materialise(groups.join(weights, "rep").join(components.withColumnRenamed("node", "rep"), "rep"), "near-groups")
    central = placed.groupBy("group").agg(
        F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("x"), F.count(F.lit(1)).alias("size")
    )
    salts = F.ceil(F.col("size") / GROUP_ROWS).cast("int")
    central = materialise(central.select("group", "size", (-F.col("x.rep")).alias("centre"), salts.alias("salts")), "near-centres")
    every_salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    salted = join_to_one(placed.drop("weight"), central.select("group", "salts"), ["group"])
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")).drop("salts")
    centres = central.join(sets.select(F.col("rep").alias("centre"), F.col("shingles").alias("of_centre")), "centre")
    centres = centres.groupBy("group", "salts").agg(F.min("of_centre").alias("of_centre"))  # an id may repeat with two texts
    centres = centres.select("group", "of_centre", every_salt)
    apart = F.concat(F.array_except("shingles", "of_centre"), F.array_except("of_centre", "shingles"))
    members = salted.join(sets, "rep").join(centres, ["group", "salt"])
    members = members.select("group", "salt", "rep", "component", F.size("shingles").cast("long").alias("n"), apart.alias("diff"))
    members = members.withColumn("d", F.size("diff").cast("long")).withColumn("score", above * F.col("d") - below * F.col("n"))
    members = materialise(members, "near-differences")

    # those whose differences with the member nearest to the centre can't be too many are linked to it
    nearest = members.groupBy("group").agg(F.min(F.struct("score", "rep", "component")).alias("nearest"))
    linked = F.col("score") + F.col("nearest.score") <= 0
    met = materialise(join_to_one(members, nearest, ["group"]), "near-distances")
    sure = met.where(linked & (F.col("rep") != F.col("nearest.rep")) & (F.col("component") != F.col("nearest.component")))
    sure = sure.select(F.col("nearest.rep").alias("a"), F.col("rep").alias("b"))

    over = F.greatest(F.lit(1.0), F.col("score") / (8.0 * above))
    rest = met.withColumn("component", F.when(linked, F.col("nearest.component")).otherwise(F.col("component"))).drop("nearest")
    rest = rest.withColumn("level", F.floor(F.log(over) / F.log(F.lit(STEP))).cast("int"))
    levels = rest.groupBy("group", "level").agg(
        F.min("score").alias("least"), F.max("d").alias("widest"), F.min("component").alias("c0"), F.max("component").alias("c1")
    )
    levels = levels.groupBy("group").agg(F.collect_list(F.struct("level", "least", "widest", "c0", "c1")).alias("levels"))
    counts = rest.select("group", F.explode("diff").alias("token")).groupBy("group", "token").agg(F.count(F.lit(1)).alias("held"))
    common = join_to_one(materialise(counts.where("held > 1"), "near-counts"), central.select("group", "size"), ["group"])
    common = common.where(F.col("held") * COMMON >= F.col("size")).groupBy("group").agg(F.collect_list(F.struct("token", "held")).alias("common"))
    none = F.array().cast("array<struct<token: long, held: long>>")
    known = central.select("group", "salts").join(levels, "group").join(common, "group", "left")
    known = known.select("group", "levels", F.coalesce("common", none).alias("common"), every_salt)
    fields = "group long, rep long, component long, n long, d long, level int, score long, token long, low int, high int, place int"
    first = materialise(map_batches(rest.join(known, ["group", "salt"]), _prefix_rows(percent), fields), "near-prefixes")

    key = ["group", "token", "low", "high"]
    several = first.groupBy(*key).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select(*key)
    first = materialise(first.join(several, key, "left_semi"), "near-prefixes-met")
    x, y = first.where("level = low").alias("x"), first.where("level = high").alias("y")
    most = F.least(F.col("x.d") - F.col("x.place"), F.col("y.d") - F.col("y.place"))  # this token and all after it
    enough = most * (2 * above) >= F.col("x.score") + F.col("y.score")
    once = (F.col("low") < F.col("high")) | (F.col("x.rep") < F.col("y.rep"))
    pairs = x.join(y, key).where((F.col("x.component") != F.col("y.component")) & once & enough)
    pairs = pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).unionByName(sure)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set is the text's distinct
    shingles of ``words`` words, or the whole sequence if there are fewer. Two documents are
    linked if 100 * intersection >= percent * union of their sets; component_id is the
    smallest id that links reach. A text without words (null, empty) has no shingle and no
    link. Rows that repeat an id are one document with the links of each. A row with a null
    id is linked with nothing, has a null component and is kept. Other columns are ignored;
    an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "doc_id long, n_shingles long, sig1 long, sig2 long, bands array<long>"
    marks = materialise(map_batches(base, _sketch_rows(words), schema), "near-sketches")

    key = ["sig1", "sig2", "n_shingles"]
    of = marks.where("n_shingles > 0 and doc_id is not null")
    classes = of.groupBy(*key).agg(F.min(F.struct("doc_id", "bands")).alias("x"))
    classes = materialise(classes.select(*key, F.col("x.doc_id").alias("rep"), "x.bands"), "near-classes")

    dealt = classes.select(F.col("rep"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "h"))
    leaders = dealt.groupBy("band", "h").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("rep", "n")).alias("lead"))
    leaders = leaders.where("members > 1").select("band", "h", "members", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n"))
    dealt = materialise(dealt, "near-dealt")
    buckets = materialise(join_to_one(dealt, leaders, ["band", "h"]), "near-buckets")
    discard(dealt)

    needed = buckets.select("rep").distinct()
    texts = materialise(base.select(F.col("doc_id").alias("rep"), "text").join(needed, "rep"), "near-texts")

    met = buckets.where("lead <> rep").where(F.least("lead_n", "n") * 100 >= F.greatest("lead_n", "n") * percent)
    pairs = materialise(met.select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "near-pairs")
    edges = materialise(_verified(pairs, texts, words, percent), "near-links")
    # an id of several classes ties them together, whether or not it represents one
    repeated = of.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).where("x <> y")
    repeated = materialise(repeated.select("doc_id"), "near-repeated-ids")
    links = edges
    if not repeated.isEmpty():
        ties = of.drop("bands").join(repeated, "doc_id", "left_semi").join(classes.select(*key, "rep"), key)
        links = edges.unionByName(ties.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    components = connected_components(links, classes.select(F.col("rep").alias("node")))

    # what no leader has met yet: members of buckets that aren't connected
    rest = buckets.where("lead <> rep and members > 2").select("band", "h", "rep")
    known = materialise(rest.join(components.withColumnRenamed("node", "rep"), "rep"), "near-open")
    mixed = known.groupBy("band", "h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    open_ = materialise(join_to_one(known.drop("component"), mixed.select("band", "h"), ["band", "h"], "left_semi"), "near-mixed")
    if not open_.isEmpty():
        own = texts.join(open_.select("rep").distinct(), "rep", "left_semi")
        own = materialise(map_batches(own, _set_rows(words), "rep long, shingles array<long>"), "near-open-sets")
        pairs = materialise(_unmet_pairs(open_, own, components, percent), "near-pairs")
        new = materialise(_verified(pairs, texts, words, percent), "near-links")
        # only the components that a new link joins change
        of_a = components.select(F.col("node").alias("a"), F.col("component").alias("c_a"))
        of_b = components.select(F.col("node").alias("b"), F.col("component").alias("c_b"))
        joined = new.join(of_a, "a").join(of_b, "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct()
        joined = materialise(joined, "near-joined")
        after = connected_components(joined).select(F.col("node").alias("component"), F.col("component").alias("further"))
        components = join_to_one(components, after, ["component"], "left")
        components = components.select("node", F.coalesce("further", "component").alias("component"))

    of_class = classes.select(*key, "rep").join(components.withColumnRenamed("node", "rep"), "rep").select(*key, "component")
    joined = join_to_one(marks.drop("bands"), of_class, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(component)
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def drop_near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The input's rows and columns, of each component the rows with its smallest id.

    Documents without words and rows with a null id all stay.
    """
    gone = unused_name(docs)
    found = near_duplicates(docs, words, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(gone))
    return docs.join(found.distinct(), docs[id_col] == F.col(gone), "left_anti")
