"""Line dedup by a log-template tree (DataFrame functions only).

Lines are parsed to a fixed depth: first by token count, then by their leading
tokens; tokens with digits, addresses and links are wildcards from the start. A
leaf of the tree generalises further: a position where most of its distinct lines
agree is constant, any other a wildcard. A template recurs if lines of it stand in
many unrelated documents, however many copies of one text hold it too; its lines are
dropped everywhere. Copies and near copies of one text are one family, so the content
of a large group of them is no template (near-duplicate removal is for that). A family
is told without the line judged: ``BANDS`` keys, each of two least hashes of three-word
shingles of the other lines; documents that agree on a key are related.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .simhash import components

#: A template recurs from so many families on.
MIN_FAMILIES = 10
#: Keys of a document; near copies of shingle likeness J miss all of them with (1 - J * J) ** BANDS.
BANDS = 8
#: Orders of the hashes, two for a key: exclusive-or with 64-bit constants.
ORDERS = [int.from_bytes(sha256(b"%d" % j).digest()[:8], "little", signed=True) for j in range(2 * BANDS)]
#: Lines of more words have one shingle of so many in the keys.
SAMPLED, SAMPLE = 16, 4
#: Depth of the tree below the token count.
LEADING = 3
CONSTANT = 0.6
#: Up to so many crowded leaves are broadcast (8 bytes each); more are joined.
BROADCAST_LEAVES = 200_000
AGREE = 0.8
_VARIABLE = r"(?<![^ ])(?=[^ ]*?(?:[0-9@]|://))[^ ]+"
#: What a line must have for anything in it to be replaced.
_REPLACED = r"[\x09-\x0D0-9@]|  |://"
_BLANKS = r"[\x20\x09-\x0D]+"
_BLANK = " \t\n\x0b\f\r"


def masked(line: Column) -> Column:
    """A line with single blanks between tokens and wildcards for variable ones. Most
    lines need no replacement, so both are behind one plain search."""
    plain = F.trim(F.regexp_replace(line, _BLANKS, " "))
    return F.when(line.rlike(_REPLACED), F.regexp_replace(plain, _VARIABLE, "<*>")).otherwise(F.trim(line))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _shingles(words: Column) -> Column:
    """Shingle hashes; of a long line the first and those that are 0 modulo ``SAMPLE``."""
    hashes = F.transform(words, lambda w, k: F.xxhash64(w, F.get(words, k + 1), F.get(words, k + 2)))
    return F.when(F.size(words) <= SAMPLED, hashes).otherwise(F.filter(hashes, lambda h, k: (k == 0) | (h.bitwiseAND(F.lit(SAMPLE - 1)) == 0)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _masked_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """``no, line`` of every non-blank line of ``docs(text)``, and columns ``keep``."""
    rows = docs.select(*keep, F.posexplode(_lines(F.col("text"))).alias("no", "raw"))
    return rows.where(F.trim("raw", F.lit(_BLANK)) != "").select(*keep, "no", masked(F.col("raw")).alias("line"))


def parsed_lines(docs: DataFrame) -> DataFrame:
    """``i, t, no, exact, leaf, line`` of every non-blank line of ``docs(i, t, text)``."""
    return _masked_lines(docs, "i", "t").select("i", "t", "no", F.xxhash64("line").alias("exact"), _leaf(F.col("line")).alias("leaf"), "line")


def sketches(docs: DataFrame) -> DataFrame:
    """``t, first, second`` of ``docs(t, text)``: for each order the least shingle hash
    with its line, and the least one in all other lines. Shingles are brought to one
    row a line where they are made."""
    orders = range(len(ORDERS))
    words = _masked_lines(docs, "t").select("t", F.xxhash64("line").alias("exact"), F.split("line", " ").alias("words"))
    hashes = words.select("t", "exact", F.explode(_shingles(F.col("words"))).alias("h"))
    lines = hashes.groupBy("t", "exact").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(s))).alias(f"m{j}") for j, s in enumerate(ORDERS)])
    known = lines.groupBy("t").agg(F.collect_list(F.struct("exact", F.array(*[f"m{j}" for j in orders]).alias("least"))).alias("lines"))
    known = known.select("t", "lines", F.array(*[_first(F.col("lines"), j) for j in orders]).alias("first"))
    return known.select("t", "first", F.array(*[_second(F.col("lines"), F.col("first"), j) for j in orders]).alias("second"))


def rest_keys(exact: Column, first: Column, second: Column) -> Column:
    """``BANDS`` keys of a document without one of its lines."""
    orders = range(len(ORDERS))
    value = lambda j: F.when(first[j]["exact"] == exact, second[j]).otherwise(first[j]["m"])
    return F.array(*[F.xxhash64(F.lit(b), *[value(j) for j in orders[b::BANDS]]).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") for b in range(BANDS)])


def _first(lines: Column, j: int) -> Column:
    """The least of an order, with its line."""
    return F.array_min(F.transform(lines, lambda p: F.when(p["least"][j].isNotNull(), F.struct(p["least"][j].alias("m"), p["exact"].alias("exact")))))


def _second(lines: Column, first: Column, j: int) -> Column:
    """The least of an order in all other lines than the first's."""
    return F.array_min(F.transform(F.filter(lines, lambda p: p["exact"] != first[j]["exact"]), lambda p: p["least"][j]))


def _leaf(line: Column) -> Column:
    """The token count and the leading tokens, of which a short line has one less than
    tokens, so that one can vary."""
    size = F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    lead = F.substring_index(line, " ", LEADING)
    for n in range(2, LEADING + 1):
        lead = F.when(size == n, F.substring_index(line, " ", n - 1)).otherwise(lead)
    return F.xxhash64(size, lead)


def families(rows: DataFrame) -> DataFrame:
    """``g, families`` of ``rows(g, rest)``: rows of a group with a key in common are
    related, and so are those between which relations lead."""
    nodes = materialize(rows.distinct().select("g", F.xxhash64("g", "rest").alias("node"), "rest"))
    keys = nodes.select("node", "g", F.posexplode("rest").alias("band", "key")).select("node", F.xxhash64("g", "band", "key").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("b")).where("n > 1").select("key", "b")
    roots = components(keys.join(shared, "key").select(F.col("node").alias("a"), "b"))
    return nodes.select("g", "node").join(roots.where("node <> root"), "node", "left").groupBy("g").agg((F.count("*") - F.count("root")).alias("families"))


def recurring_lines(lines: DataFrame, docs: DataFrame, min_families: int = MIN_FAMILIES) -> tuple[DataFrame, DataFrame]:
    """``exact``: hashes of the masked lines whose template recurs in ``docs(i, t,
    text)``; and the written table ``lines`` anew without what is not needed further,
    in place of the one given. Lines of different texts are counted first; only
    documents with a line in enough of them are looked at again, each text once."""
    seen = lines.select("exact", "leaf", "t").distinct().groupBy("exact").agg(F.first("leaf").alias("leaf"), F.count("*").alias("n"))
    seen = materialize(seen)
    exacts = seen.where(F.col("n") >= min_families).select("exact")
    crowded = seen.groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where((F.col("n") >= min_families) & (F.col("kinds") > 1)).select("leaf")
    leaves = crowded = materialize(crowded)
    if crowded.count() <= BROADCAST_LEAVES:
        crowded = F.broadcast(crowded)
    # one line of each kind, and only then its tokens
    members = lines.join(crowded, "leaf", "left_semi").groupBy("exact").agg(F.first("leaf").alias("leaf"), F.first("line").alias("line"))
    members = materialize(members.select("exact", "leaf", F.split("line", " ").alias("tokens")))
    whole, lines = lines, materialize(lines.select("i", "t", "no", "exact"))
    release(whole)
    tokens = members.select("leaf", F.posexplode("tokens").alias("pos", "token")).groupBy("leaf", "pos", "token").count()
    common = tokens.groupBy("leaf", "pos").agg(F.max(F.struct("count", "token")).alias("top"), F.sum("count").alias("n")).where(F.col("top.count") * 2 > F.col("n"))
    trees = common.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.col("top.token").alias("token")))).alias("fixed"))
    # written, so that a join with a leaf's many lines can be split
    trees = materialize(trees)
    agree = F.aggregate(F.map_entries("fixed"), F.lit(0), lambda n, e: n + F.when(F.col("tokens")[e["key"]] == e["value"], 1).otherwise(0))
    matched = members.join(trees, "leaf").where((F.size("fixed") >= CONSTANT * F.size("tokens")) & (agree >= AGREE * F.size("fixed"))).select("exact", "leaf")
    # a group for each exact line and each template, if enough different texts have it
    groups = exacts.select("exact", F.xxhash64(F.lit(0), "exact").alias("g")).unionByName(matched.select("exact", F.xxhash64(F.lit(1), "leaf").alias("g")))
    groups = groups.join(seen.select("exact", "n"), "exact")
    # written, as are the families below, so that joins with a group's many lines can be split
    wide = materialize(groups.groupBy("g").agg(F.sum("n").alias("all")).where(F.col("all") >= min_families).select("g"))
    kept = groups = materialize(groups.join(wide, "g", "left_semi").select("exact", "g"))
    release(members, leaves, trees)
    kinds = groups.select("exact").distinct()
    if groups.count() <= BROADCAST_LEAVES:
        kinds, groups = F.broadcast(kinds), F.broadcast(groups)
    held = materialize(lines.join(kinds, "exact", "left_semi").groupBy("exact", "t").agg(F.min("i").alias("i")))
    # both joins with texts sort and merge at any size, so that none depends on a side being small
    chosen = materialize(held.groupBy(F.col("t").alias("ht")).agg(F.min("i").alias("hi")))
    known = materialize(sketches(docs.join(chosen.hint("merge"), (F.col("i") == F.col("hi")) & (F.col("t") == F.col("ht")), "left_semi")))
    rest = materialize(held.join(known, "t").select("exact", rest_keys(F.col("exact"), F.col("first"), F.col("second")).alias("rest")).distinct())
    wide = materialize(families(rest.join(groups, "exact").select("g", "rest")).where(F.col("families") >= min_families))
    recurring = materialize(groups.join(wide, "g", "left_semi").select("exact").distinct())
    release(seen, kept, held, chosen, known, rest)
    return recurring, lines


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_families: int = MIN_FAMILIES) -> DataFrame:
    """``docs`` with recurring lines cut from the text, and two more columns,
    ``__lines`` and ``__dropped``; a row per input row.

    Blank lines stay. A null text stays null with no lines. Rows are told apart by
    id and text, so equal rows fare alike; rows without id are treated like any
    other. Texts and lines of any length are read whole; where two tokens are equally
    frequent at a place of a template, neither is a majority and the place varies. An
    empty table gives an empty result. All columns of ``docs`` pass, but columns of the
    two new names are replaced.
    """
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("__lines", "__dropped")]
    return _cleaned(docs, id_col, text_col, min_families).select(*rest, F.col("lines").alias("__lines"), F.col("dropped").alias("__dropped"))


def _cleaned(docs: DataFrame, id_col: str, text_col: str, min_families: int) -> DataFrame:
    """``row, lines, dropped``: rows of ``docs`` with the text cut."""
    text = F.col(text_col).cast("string")
    names = docs.columns
    id_key, text_key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), F.xxhash64(text)
    keyed = docs.select(id_key.alias("i"), text_key.alias("t"), text.alias("text"))
    lines = materialize(parsed_lines(keyed))
    drop, lines = recurring_lines(lines, keyed, min_families)
    bits = lines.join(drop, "exact", "left_semi").groupBy(F.col("i").alias("__i"), F.col("t").alias("__t"), F.floor(F.col("no") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, no % 64)")).alias("bits"))
    gone = bits.groupBy("__i", "__t").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("__gone"), F.sum(F.bit_count("bits")).alias("__n"))
    gone = materialize(gone)
    release(lines, drop)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), text.alias("__text"), id_key.alias("__i"), text_key.alias("__t")).join(gone.hint("merge"), ["__i", "__t"], "left")
    new = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(_bound(_lines(F.col("__text")), lambda lines: F.array_join(_left(lines, F.col("__gone")), "\n")))
    columns = [(new if c == text_col else F.col("__row").getField(c)).alias(c) for c in names]
    count = F.when(F.col("__text").isNull(), 0).otherwise(F.size(_lines(F.col("__text"))))
    return held.select(F.struct(*columns).alias("row"), count.cast("long").alias("lines"), F.coalesce("__n", F.lit(0)).cast("long").alias("dropped"))


def _left(lines: Column, gone: Column) -> Column:
    """The lines whose bits are not set in ``gone`` (number of 64 lines → bits), 64 by 64."""

    def block(w: Column) -> Column:
        return _bound(F.coalesce(F.try_element_at(gone, w), F.lit(0).cast("long")), lambda bits: F.filter(F.slice(lines, w * 64 + 1, 64), lambda _, k: F.call_function("getbit", bits, k) == 0))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 64).cast("int")), block))


def drop_template_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_families: int = MIN_FAMILIES) -> DataFrame:
    """``docs`` without recurring lines; documents that lose all their words go, others
    stay, as do null and empty texts. A column ``n_chars`` is set to the new length.
    All columns pass, whatever their names; an empty table gives an empty result."""
    out = _cleaned(docs, id_col, text_col, min_families)
    text = F.col("row").getField(text_col)
    out = out.where((F.col("dropped") == 0) | text.rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("dropped") == 0, F.col("row.n_chars")).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("row", F.col("row").withField("n_chars", length))
    return out.select("row.*")
