"""Similarity join of word shingles through a token-group matrix.

Every text becomes the set of its four-word shingles (64-bit hashes); equal sets are one
class. Two classes link when they share 85 % of their union.

1. Prefixes. In one order of all tokens, two linked sets share a token among the first
   p = n - ceil(0.85 n) + 1 of each, and k + 1 tokens among the first p + k. Prefixes are half
   as long again as p, so a few tokens in common, as of a shared passage, are not enough. The
   order is that of the hashes, with frequent tokens last: those in more than `HOT` prefixes
   are kept in a bitmap of fixed size. Any order is right; this one keeps tokens that a third
   of all texts share out of prefixes. Classes that share no token of their prefix are done.
2. Groups. The other classes are numbered in the order of their smallest hashes, so that
   similar ones stand together, and every `GROUP` in a row are a group. The token-group
   matrix has a row for each (token of a member's prefix, group).
3. First a class asks one group, of the first ones that hold its tokens the one with most of
   them, and the links make components. Then components are laid out in one piece each, largest
   first, and dealt into groups anew. A class asks the groups up to its own that share as many
   tokens of its prefix as sets of such sizes must, hold a set of fitting size and are not all
   of its own component; tokens of one component only are left out. So a family that hangs
   together asks little more. Tokens of more than `CROWD` prefixes are counted from group to
   group, and a class asks where those and its own other tokens may be enough; so a family
   whose members only fall short is paired by groups, not class by class. There the overlap
   with the union of the group's tokens bounds that with any member; only a group whose bound reaches 0.85 n is opened, and its members are counted on
   full sets. A class links with one member of each part of a group that already hangs
   together, so a family of any size gives no list of all its pairs.
4. Links join classes to components, classes carry their smallest doc_id.

Groups have a fixed size and classes that ask one are dealt out in portions, so a hot token,
group or family is spread. Nothing depends on chance but equal 64-bit hashes.

Null and empty texts and texts without words have no shingles and are linked with nothing; so
are rows without a doc_id. Repeated rows and copies are one class and each returned; a doc_id
with two texts gives two rows, each with the component of its text. Very long texts are
hashed whole. An empty table gives no rows. Columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewire.llm.catalog import query, table
from tidewire.llm.common import all_pairs_sql, documents_like, map_rows
from tidewire.llm.grams import Bits, collected_bits
from tidewire.llm.minhash import _Q, _mixed, components
from tidewire.operators.numbering import number_rows
from tidewire.runtime import cut

WORDS = 4
PERCENT = 85             # least similarity, in hundredths
GROUP = 64               # classes of a group
HOT = 256                # prefixes that hold a token before it is frequent
BITS = 27
PORTION = 4096           # classes that ask a group in one go
CROWD = 32               # prefixes that hold a token before its classes are not looked up one by one


def _least(n: int) -> int:
    """Tokens of a set of n that any linked set shares."""
    return -(-PERCENT * n // 100)


def _extra(n: int) -> int:
    """Tokens that the prefix of a set of n holds beyond the shortest sound one."""
    return (n - _least(n) + 1) // 2


def _needed(n: Column, least: Column, most: Column) -> Column:
    """Tokens that the prefixes of a set of n and of any linked set of least to most tokens share, at the least.

    Linked sets of n and m share at least t = 0.85 / 1.85 (n + m) tokens. Of the one whose prefix ends
    first in the order, no more than the tokens behind the prefix are shared behind it, so the prefixes
    share t less those. With the set of n that grows with m; with the other it falls with m.
    """
    share = PERCENT / (100 + PERCENT)
    short = n - F.floor((PERCENT * n + 99) / 100) + 1
    own = share * (n + least) - n + short + F.floor(short / 2)
    # the prefix of m tokens has at least 0.225 m - 0.5 of them
    other = share * (n + most) - (1 - 1.5 * (1 - PERCENT / 100)) * most - 0.5
    return F.least(own, other) - 1e-6


class _Words(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxh64_intdigest(word)
        if len(self) < 400_000:
            self[word] = value
        return value


_words = _Words()


def token_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    out: list[np.ndarray] = []
    for start in range(0, len(texts), 500):
        words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts[start:start + 500]]
        first = np.cumsum([0] + [len(w) for w in words])
        word = np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=first[-1])
        with np.errstate(over="ignore"):
            n = max(0, len(word) - WORDS + 1)
            shingle = word[:n].copy()
            for k in range(1, WORDS):
                shingle = shingle * _Q + word[k:k + n]
            shingle = _mixed(shingle)
            for a, b in zip(first.tolist(), first[1:].tolist()):
                if b - a >= WORDS:
                    each = np.sort(shingle[a:b - WORDS + 1])
                    fresh = np.ones(len(each), dtype=bool)
                    np.not_equal(each[1:], each[:-1], out=fresh[1:])
                    out.append(each[fresh])
                else:
                    whole = np.array([b - a], dtype=np.uint64)
                    for w in word[a:b]:
                        whole = whole * _Q + w
                    out.append(_mixed(whole) if b > a else word[:0])
    return out


def _key(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def _prefix(tokens: np.ndarray, hot: Bits | None) -> np.ndarray:
    size = len(tokens) - _least(len(tokens)) + 1
    size += size // 2
    if hot is None or not len(tokens):
        return tokens[:size]
    last = hot.has(tokens)
    return np.concatenate([tokens[~last], tokens[last]])[:size] if last.any() else tokens[:size]


def classed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (null for empty sets), low (the smallest hashes) of every row."""
    def run(doc_id, text):
        sets = token_sets(text)
        low = [s[:3].view(np.int64).tolist() if len(s) else None for s in sets]
        return {"doc_id": doc_id, "n_shingles": [len(s) for s in sets], "set_key": [_key(s) for s in sets], "low": low}
    return map_rows(docs, ["doc_id", "text"], run, "doc_id bigint, n_shingles bigint, set_key binary, low array<bigint>")


def _bit() -> Column:
    return (F.shiftrightunsigned("token", 64 - BITS) + 1).alias("bit")


def prefixes(docs: DataFrame) -> DataFrame:
    """token, set_key of the prefix tokens that may stand in prefixes of several classes, for classes with enough of them."""
    context = docs.sparkSession.sparkContext

    def plain(text):
        token, key = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for s in token_sets(text):
            if len(s):
                token.append(_prefix(s, None))
                key.append(np.full(len(token[-1]), np.frombuffer(_key(s)[:8], np.int64)[0]))
        return {"token": np.concatenate(token).view(np.int64), "k": np.concatenate(key)}

    # one count tells the frequent tokens and those of several classes
    seen = map_rows(docs, ["text"], plain, "token bigint, k bigint").groupBy("token").agg(
        F.count("*").alias("c"), F.min("k").alias("a"), F.max("k").alias("b"))
    seen = cut(seen.where((F.col("c") > HOT) | (F.col("a") != F.col("b"))))
    hot = context.broadcast(collected_bits(seen.where(F.col("c") > HOT).select(_bit()), BITS))

    def moved(text):
        """Tokens that come into a prefix because frequent ones have left it."""
        order, token = Bits(hot.value), [np.zeros(0, np.uint64)]
        for s in token_sets(text):
            before = _prefix(s, None)
            if order.has(before).any():
                token.append(np.setdiff1d(_prefix(s, order), before, assume_unique=True))
        return {"token": np.unique(np.concatenate(token)).view(np.int64)}

    more = map_rows(docs, ["text"], moved, "token bigint")
    shared = context.broadcast(collected_bits(seen.where("a <> b").select(_bit()).union(more.select(_bit())), BITS))

    def posted(text):
        order, several, token, key = Bits(hot.value), Bits(shared.value), [np.zeros(0, np.uint64)], []
        for s in token_sets(text):
            t = _prefix(s, order)
            t = t[several.has(t)]
            # a partner is no smaller than 0.85 n, so a class with fewer shared tokens than that one's share has none
            if len(t) > _extra(_least(len(s))):
                token.append(t)
                key += [_key(s)] * len(t)
        return {"token": np.concatenate(token).view(np.int64), "set_key": key}

    return map_rows(docs, ["text"], posted, "token bigint, set_key binary").distinct()


def _parts(near: np.ndarray) -> np.ndarray:
    """Number of the connected part of every member of a group, from who is near whom."""
    part = np.arange(len(near))
    while True:
        smallest = np.where(near | np.eye(len(near), dtype=bool), part[None], len(near)).min(axis=1)
        if (smallest == part).all():
            return part
        part = smallest


class _Group:
    """Members of a group: their tokens as rows of a matrix over the union."""

    def __init__(self, texts: dict[int, str]):
        self.ids = np.array(sorted(texts))
        sets = token_sets([texts[k] for k in self.ids.tolist()])
        self.sizes = np.array([len(s) for s in sets])
        self.union = np.unique(np.concatenate(sets))
        self.holds = np.zeros((len(self.union), len(sets)), dtype=np.uint8)
        for k, s in enumerate(sets):
            self.holds[np.searchsorted(self.union, s), k] = 1
        near = np.stack([self.near(s) for s in sets])
        self.part = _parts(near | near.T)

    def bound(self, tokens: np.ndarray) -> np.ndarray:
        """Rows of the union that the tokens hit; their number bounds the overlap with any member."""
        at = np.searchsorted(self.union, tokens)
        at = at[at < len(self.union)] if len(at) and at[-1] == len(self.union) else at
        return at[self.union[at] == tokens[:len(at)]]

    def near(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each member links with a set of these tokens."""
        at = self.bound(tokens)
        if len(at) < _least(len(tokens)):
            return np.zeros(len(self.sizes), dtype=bool)
        both = self.holds[at].sum(axis=0, dtype=np.int64)
        return 100 * both >= PERCENT * (len(tokens) + self.sizes - both)

    def links(self, node: int, tokens: np.ndarray) -> list[int]:
        """A near member of each connected part; the class itself stands for its own part."""
        near = self.near(tokens)
        own = self.part[self.ids == node]
        near &= (self.ids != node) & ~np.isin(self.part, own)
        return self.ids[near][np.unique(self.part[near], return_index=True)[1]].tolist()

    def inside(self) -> list[tuple[int, int]]:
        return [(int(self.ids[k]), int(self.ids[p])) for k, p in enumerate(self.part) if k != p]


def _opened(asked: DataFrame) -> DataFrame:
    """a, b: links found by the rows (grp, portion, member, node, text), members first in each (grp, portion)."""
    def run(batches):
        held, group, at = {}, None, None
        for batch in batches:
            a, b = [], []
            rows = [batch.column(c).to_pylist() for c in ("grp", "portion", "asks", "node", "text")]
            fresh = iter(token_sets([t for t, asks in zip(rows[4], rows[2]) if asks]))
            for grp, portion, asks, node, text in zip(*rows):
                if (grp, portion) != at:
                    at, held, group = (grp, portion), {}, None
                if not asks:
                    held[node] = text
                    continue
                if group is None:
                    group = _Group(held)
                    inside = group.inside()
                    a += [x for x, _ in inside]
                    b += [y for _, y in inside]
                found = group.links(node, next(fresh))
                a += [node] * len(found)
                b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return asked.mapInArrow(run, "a bigint, b bigint")


def _dealt(asked: DataFrame, placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows for `_opened`: the members of every asked group (nodes placed in groups) and the classes that ask it."""
    asking = asked.groupBy("at").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))
    held = placed.join(asking, F.col("grp") == F.col("at")).select("grp", "node", "portions")
    members = texts.join(held, "node").select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(False).alias("asks"), "node", "text")
    ask = asked.join(asking, "at").select("node", F.col("at").alias("to"), F.pmod(F.xxhash64("node"), "portions").cast("int").alias("portion"))
    queries = texts.join(ask, "node").select(F.col("to").alias("grp"), "portion", F.lit(True).alias("asks"), "node", "text")
    return members.union(queries).repartition("grp", "portion").sortWithinPartitions("grp", "portion", "asks")


def _between(n: Column, least: Column, most: Column) -> Column:
    """The same for partners in a range of sizes; a linked set has 0.85 n to n / 0.85 tokens, whatever else there is."""
    return _needed(n, F.greatest(least, PERCENT * n / 100), F.least(most, 100 * n / PERCENT))


def _possible(rows: DataFrame) -> DataFrame:
    """The rows of the classes that hold as many tokens of other classes as a partner of their sizes needs."""
    shared = rows.groupBy("token").agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most")).where("c > 1")
    held = rows.join(shared, "token").groupBy("set_key").agg(
        F.count("*").alias("common"), F.min("least").alias("least"), F.max("most").alias("most"), F.first("n").alias("n"))
    kept = held.where(F.col("common") >= _between(F.col("n"), F.col("least"), F.col("most"))).select("set_key")
    return rows.join(kept, "set_key")


def _first_asked(rows: DataFrame) -> DataFrame:
    """node, at: the one group that a class shares most tokens with, of the first groups that hold each of its tokens."""
    firsts = rows.groupBy("token").agg(F.min("grp").alias("at"))
    met = rows.join(firsts, "token").groupBy("node", "at").agg(F.count("*").alias("common"), F.first("n").alias("n"))
    likely = F.col("common") >= _needed(F.col("n"), F.col("n"), F.col("n"))
    return met.where(likely).groupBy("node").agg(F.max_by("at", F.struct("common", -F.col("at"))).alias("at"))


def _rest_asked(rows: DataFrame) -> DataFrame:
    """node, at: the groups up to a class's own that may hold a partner of another component.

    rows: token, node, n, component, place, grp. Components stand in one piece each, the largest
    first; so of the component that comes first in a token only its last group, which it may
    share with others, matters to its own classes. A token of up to `CROWD` rows is looked up
    class by class. A crowded one only says which groups it joins: a class shares with a group at
    most the crowded tokens it holds, and at most those that its own group shares with that one.
    """
    spans = rows.groupBy("token").agg(
        F.min_by("component", "place").alias("leads"), F.min("component").alias("low"), F.max("component").alias("high"),
        (F.count("*") > CROWD).alias("crowded")).where("low <> high").select("token", "leads", "crowded")
    several = cut(rows.join(spans, "token"))
    asks = F.col("component") != F.col("leads")
    matrix = cut(several.groupBy("token", "grp", "crowded").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("low"), F.max("component").alias("high"),
        *[f(F.when(asks, F.col(c))).alias(name) for f, c, name in (
            (F.min, "n", "from_least"), (F.max, "n", "from_most"), (F.min, "component", "from_low"), (F.max, "component", "from_high"))]))
    at = [F.col("grp").alias("at"), "token", "least", "most", "low", "high"]
    fits = (100 * F.col("most") >= PERCENT * F.col("n")) & (PERCENT * F.col("least") <= 100 * F.col("n"))
    others = (F.col("low") != F.col("component")) | (F.col("high") != F.col("component"))
    before = F.col("at") <= F.col("grp")
    few = several.where(asks & ~F.col("crowded")).join(matrix.where("NOT crowded").select(*at), "token").where(fits & others & before)
    own = several.where(~asks).join(matrix.where("low <> high").drop("crowded"), ["token", "grp"]).where(fits).withColumn("at", F.col("grp"))
    both = ["node", "at", "least", "most", "n"]
    met = few.select(*both).union(own.select(*both)).groupBy("node", "at").agg(
        F.count("*").alias("common"), F.min("least").alias("least"), F.max("most").alias("most"), F.first("n").alias("n"))

    crowds = matrix.where("crowded")
    fit = (100 * F.col("most") >= PERCENT * F.col("from_least")) & (PERCENT * F.col("least") <= 100 * F.col("from_most"))
    alike = (F.col("from_low") == F.col("from_high")) & (F.col("low") == F.col("high")) & (F.col("low") == F.col("from_low"))
    joined = (crowds.where("from_low IS NOT NULL").select("token", "grp", "from_least", "from_most", "from_low", "from_high")
              .join(crowds.select(*at), "token").where(fit & ~alike & before))
    shared = cut(joined.groupBy("grp", "at").agg(
        F.count("*").alias("shared"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.min("low").alias("low"), F.max("high").alias("high")))
    held = several.where(asks & F.col("crowded")).groupBy("node", "grp").agg(
        F.count("*").alias("held"), F.first("n").alias("n"), F.first("component").alias("component"))
    by_crowds = held.join(shared, "grp").where(
        fits & others & (F.least("held", "shared") >= _between(F.col("n"), F.col("least"), F.col("most")))).select("node", "at")
    more = shared.select("grp", "at", "shared", F.col("least").alias("s_least"), F.col("most").alias("s_most"))
    counted = met.join(held.select("node", "grp", "held"), "node", "left").join(more, ["grp", "at"], "left")
    common = F.col("common") + F.when(F.col("shared").isNull(), 0).otherwise(F.least("held", "shared"))
    by_all = counted.where(common >= _between(
        F.col("n"), F.least("least", "s_least"), F.greatest("most", "s_most"))).select("node", "at")
    return by_crowds.union(by_all).distinct()


def links(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b of linked nodes; set_key, node of the classes that share a prefix token with another)."""
    sized = prefixes(docs).join(classes.select("set_key", F.col("n_shingles").alias("n")), "set_key")
    posted = cut(_possible(cut(_possible(cut(sized)))))
    involved = classes.join(posted.select("set_key").distinct(), "set_key")
    numbered = cut(number_rows(involved, ["low", "set_key"], (), "node").withColumn(
        "grp", F.floor((F.col("node") - 1) / GROUP).cast("bigint")))
    nodes = numbered.select("set_key", "node", "grp")
    rows = cut(posted.join(nodes, "set_key").select("token", "node", "grp", "n"))

    # a doc_id may have several texts and repeated rows; a task gives out one of the class's own set
    def matching(batches):
        given: set[int] = set()
        for batch in batches:
            right = [_key(s) == k for s, k in zip(token_sets(batch.column("text").to_pylist()), batch.column("set_key").to_pylist())]
            keep = []
            for ok, node in zip(right, batch.column("node").to_pylist()):
                keep.append(ok and node not in given)
                given.update([node] if ok else ())
            yield batch.select(["node", "text"]).filter(pa.array(keep, pa.bool_()))

    def opened(asked: DataFrame, placed: DataFrame) -> DataFrame:
        groups = asked.select(F.col("at").alias("grp")).distinct()
        wanted = asked.select("node").union(placed.join(groups, "grp").select("node")).distinct()
        keyed = docs.join(numbered.join(wanted, "node").select("doc_id", "set_key", "node"), "doc_id")
        texts = cut(keyed.select("set_key", "node", "text").mapInArrow(matching, "node bigint, text string"))
        return cut(_opened(_dealt(asked, placed, texts)))

    # one ask a class joins most of a family; the rest is asked across components only
    first = opened(cut(_first_asked(rows)), numbered.select("node", "grp"))
    joined = numbered.select("node").join(components(first), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))
    joined = cut(joined)
    counted = joined.join(joined.groupBy("component").agg((-F.count("*")).alias("order")), "component")
    placed = cut(number_rows(counted, ["order", "component", "node"], (), "place").select(
        "node", "component", "place", F.floor((F.col("place") - 1) / GROUP).cast("bigint").alias("grp")))
    rest = cut(_rest_asked(rows.drop("grp").join(placed, "node")))
    return opened(rest, placed.select("node", "grp")).union(first), numbered.select("set_key", "node")


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs`."""
    docs = docs.select(*documents_like())
    rows = cut(classed(docs))
    classes = cut(rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("low").alias("low")))
    found, nodes = links(docs.where("doc_id IS NOT NULL AND text <> ''"), classes)
    joined = components(cut(found))
    linked = cut(classes.select("set_key", "doc_id").join(nodes, "set_key").join(joined, "node")
                 .select("set_key", "doc_id", "component"))
    smallest = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    moved = linked.join(smallest, "component").select("set_key", "least")
    of_class = classes.select("set_key", F.col("doc_id").alias("own")).join(moved, "set_key", "left").select(
        "set_key", F.coalesce("least", "own").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


@query("op12_groups", all_pairs_sql(WORDS, PERCENT, "doc_id, n_shingles, component_id"))
def op12_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
