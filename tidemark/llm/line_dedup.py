"""Fuzzy line dedup: lines joined on pigeonhole blocks, SimHash order within a bucket, verified by edit similarity. DataFrame functions only.

A line is what stands between line feeds, normalised to lower case with every white-space run as one blank; blank lines take no part.
Equal lines are one node, whatever their length. Two different lines are linked if their edit distance is at most a fifth of the longer one's
length, counted in characters and in words; lines of scripts without blanks (over 16 bytes a word) are counted in characters only when they
meet each other. The rule is one for all lengths. Of each connected group of lines the first occurrence (smallest doc_id, then position)
stays in its document; every other occurrence goes.

1. Pigeonhole. A changed, missing or added word touches two pairs of neighbouring words at most. A line of n words may so lose 2 * (n / 5)
   pairs, and one more where its partner has a word more than it: of its 2 * (n / 5) + 1 (or + 2) first pairs in any order that all lines
   share, one is also among the first pairs of every line it is linked with. Those pairs are the line's blocks; none is left out, so no link is. The order puts
   pairs last that stand often in a sample of lines (SAMPLE, counters of fixed size: PAIR_BITS), then those of short words; it decides how many lines
   meet, not which are linked.
   Lines of scripts without blanks have blocks of characters in place of words as well.
2. All pairs of a bucket of up to SMALL lines are taken at once, neighbours and those with the first line to be compared first, the others
   where they are not connected by then. SimHash. The words of a line vote for the bits of its SimHash. Lines of larger buckets are put in its
   order; each is compared with the one before it and with the first, which links most of what belongs together.
3. Then the lines of each larger bucket that are in another component than most of the bucket are compared with all lines of other components, LEADERS
   of them in the first turn and 16 times as many in each further one, with components anew after each turn. Every pair of a bucket is so compared or connected, in small and large ones alike.
   A pair whose block stands at places that no allowed number of changes brings together is not compared there: the block that links it stands at fitting ones.
4. The distance in words goes first, being far cheaper than in characters: a word is a sign there (one of SIGNS, by its hash; words of one sign only bring
   lines closer, which the characters then decide). Then one way to change the words of a line to those of the other: where its changes and their characters
   are few enough, so is the distance. That in characters is taken between what is left without the common beginning and end. Where that is over PIECE * 2 characters, pieces of
   WORDS words (of PIECE characters in scripts without blanks) are compared one by one and their distances added: never less than the
   true distance, so enough to link; where it is not, the true distance decides.

Defined results: a null text counts as empty; a text is split whole, however long; rows that repeat a doc_id count as one document; a
null doc_id is smaller than any; ties do not arise, (doc_id, position) being one occurrence; an empty table gives an empty result;
drop_lines() keeps all other columns, but n_lines and n_dropped are its own. Lines are told apart by 128 bits of hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_written, table, texts
from tidemark.llm.components import components

#: Fewest words of a line that can be linked with others than its equals (four words with five); edit distance times EDIT_SHARE may not exceed
#: the longer line's length: a similarity of 0.8.
FUZZY_WORDS, EDIT_SHARE = 4, 5
#: Most lines of a bucket whose pairs are all taken at once.
SMALL = 8
#: Lines of a bucket that are compared with all others in the first turn, characters and words of a piece.
LEADERS, PIECE, WORDS = 8, 1024, 128
#: Different signs that words are told apart by; all below the surrogates of UTF-16.
SIGNS = 50_000
#: Most lines, about, that say which pairs of words are common, and the bits of a pair's hash that name its counter.
SAMPLE, PAIR_BITS = 1 << 17, 20
#: Bits of a block's place in its line, of its hash and of its rarity by length: above all stands a step of how common it is, of STEPS.
PLACE_BITS, HASH_BITS, LENGTH_BITS, STEPS = 20, 33, 6, 4
#: Bits of the filter of lines that are fetched.
FILTER_BITS = 1 << 22
#: Numbers of 64 bits that tell a line's words, and feet of four counters of 16 bits.
MASKS, FEET = 4, 0x0001000100010001


def normal(line: Column) -> Column:
    """Lower case, white-space runs as one blank, none at the ends. The pattern only runs where a line needs it."""
    low = F.lower(line)
    odd = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\f")])
    return F.trim(F.when(odd, F.regexp_replace(low, r"\s+", " ")).otherwise(low))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, norm, h1, h2 (128 bits that identify norm) of all lines that are not blank."""
    # lines are normalised within the array, so that Spark does not state the expression again for each use
    out = docs.select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), normal)).alias("pos", "norm")).where("norm <> ''")
    return out.withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64("norm", F.lit("2"))})


def distinct_lines(docs: DataFrame) -> DataFrame:
    """h1, h2, at (its first occurrence), n (number of occurrences), norm of each different line."""
    found = lines(docs).groupBy("h1", "h2")
    return found.agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.count(F.lit(1)).alias("n"), F.first("norm").alias("norm"))


def spaced(norm: Column) -> Column:
    """Whether a line is of a script with blanks."""
    return F.octet_length(norm) <= 16 * F.size(F.split(norm, " "))


def units(found: DataFrame, *names: str) -> DataFrame:
    """names and the units of each line: its words, and in scripts without blanks its characters, too."""
    words = F.split("norm", " ")
    kinds = F.when(spaced(F.col("norm")), F.array(words)).otherwise(F.array(words, F.split("norm", "")))
    return found.select(*names, F.explode(kinds).alias("units")).where(F.size("units") >= FUZZY_WORDS)


def unit_hash(unit: Column | str) -> Column:
    return F.xxhash64(unit)


def pair_hashes(units: str) -> Column:
    """A hash of each unit and the one behind it, its upper LENGTH_BITS bits the lower the longer both are (most long words are rare)."""
    most = (1 << LENGTH_BITS) - 1

    def pair(x: Column, i: Column) -> Column:
        y = F.col(units)[i + 1]
        short = F.lit(most) - F.least(F.length(x) + F.length(y), F.lit(most))
        return F.coalesce(F.shiftleft(short.cast("long"), 64 - LENGTH_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(x, y), LENGTH_BITS)), F.lit(0).cast("long"))

    return F.transform(F.slice(units, F.lit(1), F.size(units) - 1), pair)


def commonness(found: DataFrame) -> Column:
    """An array of numbers that hold a step, two bits each, for each value of PAIR_BITS bits of a pair's hash: 0 for most, more for those that stand much
    more often than others in about SAMPLE lines, chosen by a hash. The steps put blocks in order and decide nothing else, so that any lines may be asked."""
    share = SAMPLE / max(1, found.count())
    some = units(found.where(F.pmod(F.xxhash64("norm", F.lit("3")), F.lit(1 << 20)) < share * (1 << 20)))
    slot = F.col("pair").bitwiseAND(F.lit((1 << PAIR_BITS) - 1)).alias("slot")
    counts = cut(some.select(F.explode(pair_hashes("units")).alias("pair")).groupBy(slot).agg(F.count(F.lit(1)).alias("n")), "counts")
    usual = 2 * (counts.agg(F.sum("n")).first()[0] or 0) / (1 << PAIR_BITS) + 2
    step = F.least(F.floor(F.log2(F.col("n") / usual) / 2) + 1, F.lit(STEPS - 1)).cast("long")
    word, place = F.shiftright("slot", 5).alias("word"), F.col("slot").bitwiseAND(F.lit(31)).cast("int") * 2
    often = [0] * (1 << PAIR_BITS - 5)
    for r in counts.where(F.col("n") >= usual).groupBy(word).agg(F.bit_or(F.call_function("shiftleft", step, place)).alias("steps")).collect():  # a row for each number
        often[r["word"]] = r["steps"]
    drop_written(counts)
    return F.split(F.lit(",".join(map(str, often))), ",").cast("array<bigint>")


def blocks(found: DataFrame, name: str = "h1") -> DataFrame:
    """(name, key, n, place) of each block of distinct_lines(): number of words, place of the block among them (null: several)."""
    often = commonness(found)
    told = units(found, name).select(name, F.size("units").alias("n"), pair_hashes("units").alias("h"))

    def pair(h: Column, i: Column) -> Column:
        steps = often[F.shiftright(h, 5).bitwiseAND(F.lit((1 << PAIR_BITS - 5) - 1))]
        own = F.call_function("shiftrightunsigned", steps, F.shiftleft(h.bitwiseAND(F.lit(31)).cast("int"), 1)).bitwiseAND(F.lit(STEPS - 1))
        step = F.shiftleft(own, LENGTH_BITS + HASH_BITS)
        whole = F.shiftleft(step.bitwiseOR(F.shiftrightunsigned(h, 64 - LENGTH_BITS - HASH_BITS)), PLACE_BITS)
        return F.coalesce(whole.bitwiseOR(F.least(i, F.lit((1 << PLACE_BITS) - 1)).cast("long")), F.lit(0).cast("long"))  # never null: sorted as numbers

    told = told.select(name, "n", F.sort_array(F.transform("h", pair)).alias("pairs"))
    # a partner with one word more may have one change more
    first = 2 * F.floor(F.col("n") / EDIT_SHARE) + 1 + (F.col("n") % EDIT_SHARE == EDIT_SHARE - 1).cast("int")

    def once(v: Column, i: Column) -> Column:
        """v, its place as unknown where the pair stands several times."""
        def same(j: Column) -> Column:
            return F.coalesce(F.shiftrightunsigned(F.get("pairs", j), PLACE_BITS) == F.shiftrightunsigned(v, PLACE_BITS), F.lit(False))
        return F.when(same(i + 1) | same(i - 1), v.bitwiseOR(F.lit((1 << PLACE_BITS) - 1))).otherwise(v)

    taken = F.slice("pairs", F.lit(1), first.cast("int"))
    # one pair more than is taken, whose like may be the last of them
    keys = F.transform(F.slice("pairs", F.lit(1), first.cast("int") + 1), lambda v: F.shiftrightunsigned(v, PLACE_BITS))
    told = told.select(name, "n", "pairs", taken.alias("taken"), keys.alias("keys"))
    told = told.select(name, "n", F.when(F.size(F.array_distinct("keys")) == F.size("keys"), F.col("taken")).otherwise(F.array_distinct(F.transform("taken", once))).alias("pairs"))
    # (outer: Spark would else ask whether there are pairs before it has made them, with all steps stated again within each other)
    told = told.select(name, "n", F.explode_outer("pairs").alias("pair"))
    place = F.col("pair").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    return told.select(name, F.shiftrightunsigned("pair", PLACE_BITS).alias("key"), "n", F.when(place < (1 << PLACE_BITS) - 1, place).alias("place"))


def fitting(a: str, b: str) -> Column:
    """Whether lines with n_ and place_ of these sides may be linked through their block: changes before it and after it, an allowed number together."""
    n, m, p, q = F.col(f"n_{a}"), F.col(f"n_{b}"), F.col(f"place_{a}"), F.col(f"place_{b}")
    moved = F.coalesce(F.abs(p - q) + F.abs((n - p) - (m - q)), F.abs(n - m))
    return moved * EDIT_SHARE <= F.greatest(n, m)


def distance(a: Column, b: Column, most: Column) -> Column:
    """Edit distance, or a very large number where it is over `most` (for which the function gives -1)."""
    return F.pmod(F.call_function("levenshtein", a, b, most), F.lit(1 << 30))


def may_be_among(rows: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """The rows whose number `name` has its bit among the FILTER_BITS bits of wanted(num): all of these, and few others while they are few.

    The bits are broadcast as FILTER_BITS / 64 rows at most, so that neither the driver's Python nor a plan holds them."""
    def at(c: str) -> tuple[Column, Column]:
        slot = F.xxhash64(c).bitwiseAND(F.lit(FILTER_BITS - 1))
        return F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")

    word, place = at("num")
    bits = wanted.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    own, place = at(name)
    held = F.call_function("shiftrightunsigned", F.col("bits"), place).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(bits), (own == F.col("word")) & held, "left_semi")


def signs(words: Column) -> Column:
    """A line's words as one sign each."""
    sign = F.transform(words, lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(SIGNS)) + 1), 4, "0"))
    return F.decode(F.unhex(F.array_join(sign, "")), "UTF-16BE")


def marks(found: DataFrame) -> DataFrame:
    """num, a mask for each k below MASKS (a bit for each word, in the one that its hash names), words (their number), spaced, sim (SimHash) of each line."""
    words = F.split("norm", " ")
    told = found.select("num", F.size(words).alias("words"), spaced(F.col("norm")).alias("spaced"), words.alias("units"))
    h = told.select("num", "words", "spaced", F.explode("units").alias("unit")).select("num", "words", "spaced", unit_hash("unit").alias("h"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    masks = [F.bit_or(F.when(F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(MASKS - 1)) == k, one).otherwise(F.lit(0).cast("long"))).alias(f"mask{k}") for k in range(MASKS)]
    # a foot of 16 bits holds the votes of 65,535 words; more only make the bits less fair
    votes = [F.sum(F.shiftrightunsigned("h", 8 + k).bitwiseAND(F.lit(FEET))).alias(f"votes{k}") for k in range(2)]
    told = h.groupBy("num", "words", "spaced").agg(*masks, *votes)  # nearly all within a task, words of a line being together
    bits = [F.shiftleft((2 * F.shiftrightunsigned(f"votes{k}", 16 * j).bitwiseAND(F.lit(0xFFFF)) > F.col("words")).cast("int"), 2 * j + k) for k in range(2) for j in range(4)]
    return told.select("num", *[f"mask{k}" for k in range(MASKS)], "words", "spaced", reduce(lambda a, b: a + b, bits).cast("short").alias("sim"))


def script(v: Column, w: Column) -> Column:
    """What one way to make the words v of those of w costs, as changes << 40 | characters: word after word, looking two words ahead for one that was
    added or left out. Never less than the distance; lines of 2 ** 19 words or more cost the most."""
    at = lambda t: t.bitwiseAND(F.lit((1 << 20) - 1))  # noqa: E731  the next place in w
    cost = lambda *words: sum((F.coalesce(F.length(x), F.lit(0)) for x in words), F.lit(len(words))).cast("long")
    charged = lambda changes, c, on: F.shiftleft(F.lit(changes << 24).cast("long") + c, 20) + on

    def step(t: Column, i: Column) -> Column:
        x, y, z = F.get(v, i), F.get(w, at(t)), F.get(w, at(t) + 1)
        left_out = t + charged(1, cost(x), 0)
        ahead = F.when(x == z, t + charged(1, cost(y), 2)).when(y.isNull() | (F.get(v, i + 1) == y), left_out).when(x == F.get(w, at(t) + 2), t + charged(2, cost(y, z), 3))
        return F.when(x == y, t + 1).otherwise(ahead.when(F.get(v, i + 2) == y, left_out).otherwise(t + charged(1, F.greatest(F.length(x), F.length(y)).cast("long"), 1)))

    def rest(t: Column) -> Column:
        return F.shiftrightunsigned(F.aggregate(F.slice(w, (at(t) + 1).cast("int"), F.lit(1 << 20)), t, lambda s, y: s + charged(1, cost(y), 0)), 20)

    packed = F.aggregate(F.sequence(F.lit(0), F.size(v) - 1), F.lit(0).cast("long"), step, rest)
    small = (F.greatest(F.size(v), F.size(w)) < 1 << 19)
    return F.when(small, F.shiftleft(F.shiftrightunsigned(packed, 24), 40).bitwiseOR(packed.bitwiseAND(F.lit((1 << 24) - 1)))).otherwise(F.lit((1 << 62)))


def linked(a: Column, b: Column, signs_a: Column | None = None, signs_b: Column | None = None) -> Column:
    """Whether two lines are linked; signs(): of their words, where they are at hand. Signs tell most lines apart; one way to change the words tells most
    near copies; characters decide the others."""
    chars = F.greatest(F.length(a), F.length(b))

    def named(value: Column, judged: Callable[[Column], Column]) -> Column:
        """One-element arrays name values without stating them again."""
        return F.get(F.transform(F.array(value), judged), F.lit(0))

    def judged(v: Column, w: Column) -> Column:
        longest = F.greatest(*[F.array_max(F.transform(x, F.length)) for x in (v, w)])
        few = lambda c: (F.shiftrightunsigned(c, 40) * EDIT_SHARE <= F.greatest(F.size(v), F.size(w))) & (c.bitwiseAND(F.lit((1 << 40) - 1)) * EDIT_SHARE <= chars)
        of_a, of_b = (signs(x) if given is None else given for x, given in ((v, signs_a), (w, signs_b)))
        apart = F.when(spaced(a) | spaced(b), F.call_function("levenshtein", of_a, of_b, (F.greatest(F.size(v), F.size(w)) / EDIT_SHARE).cast("int")))
        # each change of a word costs at most its length and a blank; one more change than counted allows for two words of one sign
        sure = lambda d: F.coalesce((d + 1) * (longest + 1) * EDIT_SHARE <= chars, F.lit(False))
        return named(apart, lambda d: F.when(d < 0, False).otherwise(sure(d) | named(script(v, w), few) | near(a, b)))

    return named(F.split(a, " "), lambda v: named(F.split(b, " "), lambda w: judged(v, w)))


def near(a: Column, b: Column) -> Column:
    """Whether two texts are linked by edit similarity."""
    longer, least = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    most = (longer / EDIT_SHARE).cast("int")
    steps = F.array(*[F.lit(1 << k) for k in range(17, -1, -1)])
    head = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= least) & (F.substring(a, p + 1, s) == F.substring(b, p + 1, s)), p + s).otherwise(p))

    def tail(p: Column) -> Column:
        def same(q: Column, s: Column) -> Column:
            return F.substring(a, F.length(a) - q - s + 1, s) == F.substring(b, F.length(b) - q - s + 1, s)

        return F.aggregate(steps, F.lit(0), lambda q, s: F.when((p + q + s <= least) & same(q, s), q + s).otherwise(q))

    def apart(p: Column, q: Column) -> Column:
        x, y = (F.substring(t, p + 1, F.length(t) - p - q) for t in (a, b))
        n = longer - p - q

        def summed(ws: Column, vs: Column) -> Column:
            """Over arrays of words; a text without enough of them is cut by characters."""
            spaced = 16 * F.least(F.size(ws), F.size(vs)) >= n
            last = F.when(spaced, F.greatest(F.size(ws), F.size(vs)) / WORDS).otherwise(n / PIECE).cast("int")

            def piece(v: Column, words: Column, i: Column) -> Column:
                by_words = F.array_join(F.slice(words, i * WORDS + 1, F.lit(WORDS)), " ")
                return F.when(spaced, by_words).otherwise(F.substring(v, i * PIECE + 1, F.lit(PIECE)))

            def further(t: Column, i: Column) -> Column:
                # the blank between two pieces counts as one more
                return F.when(t <= most, t + 1 + distance(piece(x, ws, i), piece(y, vs, i), F.least(most - t, F.lit(PIECE)))).otherwise(t)

            return F.aggregate(F.sequence(F.lit(0), last), F.lit(0), further)

        def replaced(ws: Column, vs: Column) -> Column:
            """What changing word after word costs at most: enough to tell most near copies without a distance."""
            return F.aggregate(F.zip_with(ws, vs, lambda v, w: F.when(v == w, 0).otherwise(F.greatest(F.length(v), F.length(w)))), F.lit(0), lambda t, c: t + F.coalesce(c, F.lit(1 << 20)))

        def judged(ws: Column, vs: Column) -> Column:
            quick = (F.size(ws) == F.size(vs)) & (replaced(ws, vs) <= most)
            return quick | ((n > 2 * PIECE) & (summed(ws, vs) <= most)) | (distance(x, y, most) <= most)

        words = F.transform(F.array(F.split(x, " ")), lambda ws: F.get(F.transform(F.array(F.split(y, " ")), lambda vs: judged(ws, vs)), F.lit(0)))
        return (n <= most) | F.get(words, F.lit(0))

    # one-element arrays name the intermediate values without stating them again
    told = F.transform(F.array(head), lambda p: F.transform(F.array(tail(p)), lambda q: apart(p, q)))
    return ((longer - least) * EDIT_SHARE <= longer) & F.get(F.get(told, F.lit(0)), F.lit(0))


def unpacked(packed: str, end: str = "") -> list[Column]:
    """n and place of what met_lines() packs, names with `end`."""
    place = F.col(packed).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    return [F.shiftrightunsigned(packed, PLACE_BITS).cast("int").alias(f"n{end}"), F.when(place < (1 << PLACE_BITS) - 1, place).alias(f"place{end}")]


def met_lines(keyed: DataFrame) -> DataFrame:
    """Of buckets of up to SMALL lines all pairs whose places fit: num, num_b, star (whether with the first or as neighbours). Of larger ones
    their rows: key, num, packed; key is null in the others."""
    place = F.coalesce("place", F.lit((1 << PLACE_BITS) - 1)).cast("long")
    keyed = keyed.select("key", "num", F.shiftleft(F.col("n").cast("long"), PLACE_BITS).bitwiseOR(place).alias("packed")).repartition("key")
    # most blocks stand in one line: these go before rows of a bucket are put in order
    sized = keyed.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("size > 1")
    order = Window.partitionBy("key").orderBy("num", "packed")
    lags = [F.lag(c, j).over(order).alias(f"{c}{j}") for c in ("num", "packed") for j in range(1, SMALL)]
    ranked = sized.select("*", F.row_number().over(order).alias("rank"), *lags)
    before = F.array(*[F.struct(F.col(f"num{j}").alias("num_b"), F.col(f"packed{j}").alias("packed_b")) for j in range(1, SMALL)])
    others = F.when(F.col("size") <= SMALL, F.slice(before, F.lit(1), F.col("rank") - 1)).otherwise(F.slice(before, F.lit(1), F.lit(1)))
    pairs = ranked.select("key", "num", "packed", "rank", (F.col("size") > SMALL).alias("large"), F.posexplode(others).alias("at", "other"))
    pairs = pairs.select("key", "num", "packed", "large", *unpacked("packed", "_a"), "other.num_b", *unpacked("other.packed_b", "_b"), ((F.col("at") == 0) | (F.col("at") == F.col("rank") - 2)).alias("star"))
    pairs = pairs.where(F.col("large") | ((F.col("num") != F.col("num_b")) & fitting("a", "b")))
    row, pair = ([F.when(c, F.col(x)).alias(x) for x in names] for c, names in ((F.col("large"), ("key", "packed")), (~F.col("large"), ("num_b", "star"))))
    return cut(pairs.select(*row, "num", *pair), "met")


def similar_lines(found: DataFrame, keyed: DataFrame) -> DataFrame:
    """(num, component) of each line that is linked with another, by verified links. found: (num, norm); keyed: blocks() by num."""
    met = met_lines(keyed)
    masks = cut(marks(may_be_among(found, "num", met.select("num").union(met.where("num_b is not null").select("num_b")))), "line-masks")
    bucket = Window.partitionBy("key").orderBy("sim", "num")
    first = F.first(F.struct("num", "n", "place")).over(bucket).alias("first")
    before = F.lag(F.struct("num", "n", "place")).over(bucket).alias("before")
    large = met.where("key is not null").select("key", "num", *unpacked("packed"))
    members = cut(large.join(masks.select("num", "sim"), "num").select("key", "num", "n", "place", first, before), "members")
    star = met.where("key is null").select(F.least("num", "num_b").alias("num_a"), F.greatest("num", "num_b").alias("num_b"), "star")
    for other in ("first", "before"):
        sides = [F.col(c).alias(f"{c}_a") for c in ("num", "n", "place")] + [F.col(f"{other}.{c}").alias(f"{c}_b") for c in ("num", "n", "place")]
        some = members.where(F.col(f"{other}.num") != F.col("num")).select(*sides).where(fitting("a", "b"))
        star = star.union(some.select(F.least("num_a", "num_b"), F.greatest("num_a", "num_b"), F.lit(True)))
    told_by = masks.drop("sim")

    def told_apart(s: str) -> DataFrame:
        return told_by.select(*[F.col(c).alias(f"{c}_{s}") for c in told_by.columns])

    def missing(a: str, b: str) -> Column:
        return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"mask{k}_{a}").bitwiseAND(F.bitwise_not(F.col(f"mask{k}_{b}")))) for k in range(MASKS)])

    # a word that the other line has not is a change: where bits of the words tell of too many, the lines need not be fetched
    apart = F.greatest(missing("a", "b"), missing("b", "a")) * EDIT_SHARE > F.greatest("words_a", "words_b")
    possible = ~(apart & (F.col("spaced_a") | F.col("spaced_b")))

    def verified(pairs: DataFrame) -> DataFrame | None:
        """Links among possible pairs (num_a, num_b), None for none. Lines are fetched for these alone."""
        pairs = cut(pairs.select(F.least("num_a", "num_b").alias("num_a"), F.greatest("num_a", "num_b").alias("num_b")).distinct(), "possible-pairs")
        links = None
        if pairs.limit(1).count():
            both = pairs.select(F.col("num_a").alias("num")).union(pairs.select("num_b"))
            held = may_be_among(found, "num", both).select("num", "norm", signs(F.split("norm", " ")).alias("signs"))
            held = cut(held, "line-texts", compression="zstd")
            x, y = (held.select(*[F.col(c).alias(f"{c}_{s}") for c in ("num", "norm", "signs")]) for s in "ab")
            told = pairs.join(x, "num_a").join(y, "num_b").where(linked(F.col("norm_a"), F.col("norm_b"), F.col("signs_a"), F.col("signs_b")))
            links = cut(told.select(F.col("num_a").alias("a"), F.col("num_b").alias("b")), "links")
            drop_written(held)
        drop_written(pairs)
        return links

    # pairs pass the shuffles once each, before what their lines have
    once = star.groupBy("num_a", "num_b").agg(F.max("star").alias("star"))
    paired = cut(once.join(told_apart("a"), "num_a").join(told_apart("b"), "num_b").where(possible).select("num_a", "num_b", "star"), "pairs")
    drop_written(met)
    # labels: the part of each line that has a link; any other line is a part by itself
    links = verified(paired.where("star"))
    labels = None if links is None else components(links).select(F.col("node").alias("num"), F.col("component").alias("part"))
    drop_written(links)

    def parted(rows: DataFrame, num: str, part: str) -> DataFrame:
        if labels is None:
            return rows.withColumn(part, F.col(num))
        of = labels.select(F.col("num").alias("of"), F.col("part").alias("of_part"))
        return rows.join(of, F.col(num) == F.col("of"), "left").withColumn(part, F.coalesce("of_part", num)).drop("of", "of_part")

    # then the pairs that are not connected yet: those of small buckets, and in larger ones lines outside the bucket's main component lead, few
    # in the first turn and 16 times as many in each further one, as a hash names them
    places = members.select("key", "num", "n", "place", (F.col("first.num") == F.col("num")).alias("led"))
    now = parted(places, "num", "part")
    sizes = now.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size")).groupBy("key")
    mixed = sizes.agg(F.max_by("part", F.struct("size", "part")).alias("top"), F.count(F.lit(1)).alias("parts"), (F.sum("size") - F.max("size")).alias("others"))
    draw = F.pmod(F.xxhash64("num"), F.lit(1 << 30)) / float(1 << 30) * F.col("others")
    slot = F.floor(F.log2(draw * 15 / LEADERS + 1) / 4).alias("slot")
    asked = cut(now.join(mixed.where("parts > 1"), "key").where("part <> top and not led").select("key", "num", "n", "place", slot), "asked")
    last = asked.agg(F.max("slot")).first()[0]
    rest = parted(parted(paired.where("not star"), "num_a", "part_a"), "num_b", "part_b").where("part_a <> part_b").select("num_a", "num_b")
    for turn in range(1 if last is None else last + 1):
        # what tells lines apart comes with their places, so that of the pairs in a bucket only possible ones leave it
        leaders, told = asked.where(F.col("slot") == turn), parted(told_by, "num", "part")
        own = ("num", "n", "place", "part", *told_by.columns[1:])
        x = leaders.join(told, "num").select("key", *[F.col(c).alias(f"{c}_a") for c in own])
        near_by = may_be_among(places.where("not led"), "key", leaders.select(F.col("key").alias("num")))
        y = near_by.join(told, "num").select("key", *[F.col(c).alias(f"{c}_b") for c in own])
        pairs = x.join(y, "key").where((F.col("part_a") != F.col("part_b")) & fitting("a", "b") & possible).select("num_a", "num_b")
        more = verified(rest if last is None else rest.union(pairs) if turn == 0 else pairs)
        if more is not None and more.limit(1).count():
            # labels grow together where new links join them
            ends = parted(parted(more, "a", "part_a"), "b", "part_b")
            grown = components(ends.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct())
            named = ends.select(F.col("a").alias("num"), F.col("part_a").alias("part")).union(ends.select("b", "part_b"))
            named = (named if labels is None else named.union(labels)).distinct()
            old, labels = labels, cut(named.join(grown, F.col("part") == F.col("node"), "left").select("num", F.coalesce("component", "part").alias("part")), "labels")
            drop_written(old)
            drop_written(grown)
        drop_written(more)
    for done in (members, masks, paired, asked):
        drop_written(done)
    return (found.select("num", F.col("num").alias("part")).where("false") if labels is None else labels).select("num", F.col("part").alias("component"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, drop): positions of the lines that go, for documents that lose any."""
    found = cut(distinct_lines(docs).withColumn("num", F.monotonically_increasing_id()), "lines", compression="zstd")
    found.sparkSession.sparkContext._jvm.System.gc()  # the shuffle of all lines goes before that of their blocks
    groups = similar_lines(found.select("num", "norm"), blocks(found, "num"))
    named = found.select("num", "h1", "h2", "at", "n").join(groups, "num", "left").where("n > 1 or component is not null")
    named = cut(named.select("h1", "h2", "at", "component"), "repeated")
    joined = named.where("component is not null")
    least = joined.groupBy("component").agg(F.min("at").alias("least"))
    keep = named.where("component is null").select("h1", "h2", "at").union(joined.join(least, "component").select("h1", "h2", "least"))
    gone = lines(docs).select("doc_id", "pos", "h1", "h2").join(keep, ["h1", "h2"])
    gone = gone.where(~(F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("pos") == F.col("at.pos"))))
    gone = cut(gone.groupBy("doc_id").agg(F.collect_set("pos").alias("drop")), "drops")
    for done in (found, groups, named):
        drop_written(done)
    return gone


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs with the remaining text of each row, and n_lines and n_dropped; all other columns stay."""
    gone = dropped_lines(texts(docs))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = whole.join(gone, F.col("row.doc_id").eqNullSafe(F.col("doc_id")), "left").select("row", "drop", F.split(F.coalesce("row.text", F.lit("")), "\n").alias("all"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("drop"))
    text = F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("all", i)), "\n"))
    columns = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*columns, F.size("all").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).alias("n_dropped"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(texts(table(spark, sf_dir, "documents")))
