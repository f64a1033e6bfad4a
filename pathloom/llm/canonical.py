"""Mapping freely typed values to the entries of a reference list.

Distinct values are cut into tokens; each distinct token is repaired once: it is
joined to the tokens of the reference list by edit distance (insertions,
deletions, substitutions, swaps of neighbours), through the strings that remain
when up to two letters are deleted from either, or for words over ``LONG`` letters through one of five pieces,
so the join is an equi-join and finds every pair within the distance. Split and glued words are repaired through
joined neighbours on either side, and an abbreviation with a full stop through
the one word that it begins; contractions that keep a word's ending are learnt from the
values in which nothing else is missing. Corrected tokens are combined by soft TF-IDF:

    score = sum(idf^2 * sim) / sqrt(sum of idf^2 of the entry * sum of idf^2 of the value)

where the value's side counts its tokens known to the reference list only, so
words of no weight there (salts, doses, species) don't lower the score, but a
known word too many, or an entry's word missing, does. The best entry holds if
its score reaches ``threshold``; otherwise the value is reported with entry 0.
Tokens with digits are never repaired: they match exactly or not at all.

Only distinct values and tokens take part, and the table of entries may be of
any size. NULL, blank and exactly canonical values are left out; repeated rows
each get their mapping; ties go to the smaller entry id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.storage import Scratch

THRESHOLD = 0.9

#: Longer words, whose deletions are too many, are found by pieces.
LONG, PIECES = 64, 5

#: Accented letters and what they are folded to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"


def fold(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


#: A Roman numeral below ten.
ROMAN = r"^(?=[iv])(ix|iv|v?i{0,3})$"


def tokens(c: Column) -> Column:
    """Runs of letters and digits, in order; Roman numerals as digits, in values and entries alike."""

    def plain(t: Column) -> Column:
        small = F.when(t == "ix", 9).when(t == "iv", 4).otherwise(F.length(t) + F.when(t.startswith("v"), 4).otherwise(0))
        return F.when(t.rlike(ROMAN), small.cast("string")).otherwise(t)

    return F.transform(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{Nd}]+)"), 1), plain)


def allowed(length: int) -> int:
    """Edits allowed for a word of that length."""
    return 0 if length <= 3 else 1 if length <= 5 else 2


def distance(a: str, b: str) -> int:
    """Edit distance with swaps of neighbouring letters (optimal string alignment)."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
    return row[-1]


def deletions(word: str, n: int) -> list[str]:
    found = {word}
    edge = {word}
    for _ in range(n):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        found |= edge
    return sorted(found)


def _cuts(length: int) -> list[tuple[int, int]]:
    return [(length * i // PIECES, length * (i + 1) // PIECES) for i in range(PIECES)]


def pieces(word: str, shifted: bool) -> list[str]:
    """Keys of a long word: its pieces; ``shifted``: what may be the piece of a word up to two edits away.

    An edit spoils one piece, a swap of neighbours two at most, so two edits leave one of
    five as it was, at a place shifted by up to two.
    """
    if not shifted:
        return [f"{len(word)}:{i}:{word[a:b]}" for i, (a, b) in enumerate(_cuts(len(word)))]
    found = {f"{n}:{i}:{word[a + d : b + d]}" for n in range(max(LONG - 1, len(word) - 2), len(word) + 3) for i, (a, b) in enumerate(_cuts(n)) for d in range(-2, 3) if 0 <= a + d and b + d <= len(word)}
    return sorted(found)


def _keys(word: str, shifted: bool) -> list[str]:
    """Strings that a token and a word within the distance have in common; words of about ``LONG`` letters have both kinds."""
    if any(c.isdigit() for c in word):
        return [word]
    return ([word] if len(word) > LONG else deletions(word, 1 if len(word) < 6 else 2)) + (pieces(word, shifted) if len(word) > LONG - 2 else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _token_keys(words: pd.Series) -> pd.Series:
    return words.map(lambda w: _keys(w, True))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _word_keys(words: pd.Series) -> pd.Series:
    return words.map(lambda w: _keys(w, False))


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y) for x, y in zip(a, b)])


def _allowed(word: str) -> Column:
    n = F.length(word)
    return F.when(F.col(word).rlike(r"\d"), 0).when(n <= 3, 0).when(n <= 5, 1).otherwise(2)


def repairs_within(pairs: DataFrame) -> DataFrame:
    """(token, vocab, d) of ``pairs(token, vocab)`` within the distance allowed for the word.

    A swap of neighbours is two plain edits, so the plain distance tells most pairs: beyond
    twice the allowed one they are too far, and below two it is the distance itself.
    """
    p = pairs.withColumn("allowed", _allowed("vocab")).withColumn("plain", F.levenshtein("token", "vocab", 4))
    same = p.where("plain between 0 and 1").withColumn("d", F.col("plain"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = p.where("plain between 2 and 2 * allowed").repartition(parts, "token", "vocab").withColumn("d", _distance("token", "vocab"))
    return same.unionByName(rest).where("d = 0 or (d <= allowed and not token rlike '[0-9]')").select("token", "vocab", "d")


def _spans(df: DataFrame, key: str, text: str, extra: list[str]) -> DataFrame:
    """(key, extra, pos, span, token): tokens, and neighbours joined into one (span 2)."""
    t = df.select(key, *extra, tokens(F.col(text)).alias("t"))
    one = F.transform("t", lambda x, i: F.struct(i.alias("pos"), F.lit(1).alias("span"), x.alias("token")))
    two = F.transform(F.expr("slice(t, 2, greatest(size(t) - 1, 0))"), lambda x, i: F.struct(i.alias("pos"), F.lit(2).alias("span"), x.alias("token")))
    t = t.withColumn("one", one).withColumn("next", two)
    joined = F.zip_with(F.expr("slice(one, 1, greatest(size(one) - 1, 0))"), "next", lambda a, b: F.struct(a["pos"].alias("pos"), F.lit(2).alias("span"), F.concat(a["token"], b["token"]).alias("token")))
    return t.select(key, *extra, F.explode(F.concat("one", joined)).alias("s")).select(key, *extra, "s.*")


def reference_names(ref: DataFrame, ref_id: str, name: str, synonyms: str) -> DataFrame:
    """(name_id, ref_id, text): canonical names and synonyms, folded."""
    alt = ref.select(F.col(ref_id).cast("bigint").alias("ref_id"), F.explode(F.array_union(F.array(F.col(name)), F.coalesce(F.split(synonyms, r"\s*;\s*"), F.array().cast("array<string>")))).alias("raw"))
    alt = alt.where("trim(raw) <> '' and ref_id is not null").select("ref_id", fold(F.col("raw")).alias("text")).distinct()
    return alt.select(F.xxhash64("ref_id", "text").alias("name_id"), "ref_id", "text")


def contractions(v_tok: DataFrame, repairs: DataFrame, vocab: DataFrame, n_tok: DataFrame) -> DataFrame:
    """(token, vocab, sim): contractions such as "2ry" for "secondary", learnt from the values.

    A token without a repair may stand for a longer word with its last two letters. It does
    if there are values in which this very word is all that an entry lacks, and no other
    word is at least a quarter as often.
    """
    last = lambda c: F.substring(c, -2, 2)
    odd = v_tok.where("span = 1 and length(token) > 2").select("token").distinct().join(repairs, "token", "left_anti")
    words = n_tok.select(F.col("token").alias("word")).distinct().where("not word rlike '[0-9]'")
    maybe = odd.join(words, last("token") == last("word")).where("length(word) > length(token) and token rlike '[a-z]'")
    asked = v_tok.where("span = 1").join(maybe, "token").select("value", "token", "word")
    wanted = asked.join(n_tok.select(F.col("token").alias("word"), "name_id", F.col("etok").alias("lacks")), "word")
    got = v_tok.join(asked.select("value").distinct(), "value", "left_semi").join(repairs, "token").join(vocab, "vocab")
    got = got.groupBy("value", "name_id").agg(F.collect_set("etok").alias("got"))  # an entry's tokens
    sizes = n_tok.groupBy("name_id").agg(F.count("*").alias("size")).where("size > 1")
    full = wanted.join(got, ["value", "name_id"]).join(sizes, "name_id").where("size(got) = size - 1 and not array_contains(got, lacks)")
    most = full.groupBy("token", "value").agg(F.max("size").alias("size"))  # the longest entry is the one meant
    full = full.join(most, ["token", "value", "size"], "left_semi")
    votes = full.groupBy("token", "word").agg(F.countDistinct("value").alias("n"))
    best = votes.groupBy("token").agg(F.max_by("word", "n").alias("vocab"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return best.where("5 * n > 4 * all").select("token", "vocab", F.lit(0.97).alias("sim"))


def map_values(values: DataFrame, names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(value, ref_id, score) for each distinct ``value``; ref_id 0 where no entry reaches ``threshold``.

    The score is at most sqrt(dot / norm), so entries below ``threshold`` squared of their
    norm are not scored; where none is, the score is NULL.
    """
    scratch = Scratch(values.sparkSession, "canonical")
    # The entries: tokens of each name with their weights. Codes such as "ab-12" are one token, too.
    count = names.count()
    n_tok = names.select("name_id", "ref_id", F.posexplode(tokens(F.col("text"))).alias("etok", "token"))
    df_ = n_tok.select("name_id", "token").distinct().groupBy("token").count()
    idf = df_.select("token", F.pow(F.log(1 + F.lit(float(count)) / F.col("count")), 2).alias("w"))
    n_tok = scratch.cut(n_tok.join(idf, "token"), "entry-tokens")
    n_norm = n_tok.groupBy("name_id", "ref_id").agg(F.sum("w").alias("norm"))
    spans = _spans(names, "name_id", "text", [])
    # (vocab, name, entry tokens it stands for): single tokens, and neighbours written as one.
    vocab = spans.select("name_id", F.col("token").alias("vocab"), F.explode(F.sequence("pos", F.col("pos") + F.col("span") - 1)).alias("etok"))
    vocab = scratch.cut(vocab.join(n_tok.select("name_id", "etok", "w"), ["name_id", "etok"]), "vocabulary")
    words = vocab.select("vocab").distinct()

    # Repair each distinct token once.
    v = values.select("value").where("trim(value) <> ''").distinct()
    v = v.select("value", fold(F.col("value")).alias("text"))
    v_tok = scratch.cut(_spans(v, "value", "text", ["text"]).select("value", "pos", "span", "token", (F.instr(F.col("text"), F.concat("token", F.lit("."))) > 0).alias("dot")), "value-tokens")
    seen = v_tok.select("token").distinct()
    keys = seen.select("token", F.explode(_token_keys("token")).alias("key"))
    vocab_keys = words.select("vocab", F.explode(_word_keys("vocab")).alias("key"))
    near = keys.join(vocab_keys, "key").select("token", "vocab").distinct()
    near = repairs_within(scratch.cut(near, "near"))
    repairs = near.select("token", "vocab", (1 - 0.03 * F.col("d")).alias("sim"))
    # An abbreviation stands for the one word that begins with it.
    dotted = v_tok.where("span = 1 and dot and length(token) >= 2").select("token").distinct()
    heads = n_tok.groupBy(F.col("token").alias("vocab")).agg(F.countDistinct("name_id").alias("names")).where((F.col("names") > 1) & (F.length("vocab") > 2) & ~F.col("vocab").rlike(r"\d"))
    heads = heads.select("vocab", F.explode(F.sequence(F.lit(2), F.length("vocab") - 1)).alias("n")).select("vocab", F.expr("substring(vocab, 1, n)").alias("token"))
    short = dotted.join(heads, "token").groupBy("token").agg(F.min("vocab").alias("vocab"), F.max("vocab").alias("last")).where("vocab = last").select("token", "vocab", F.lit(0.97).alias("sim"))
    repairs = scratch.cut(repairs.unionByName(short).groupBy("token", "vocab").agg(F.max("sim").alias("sim")), "repairs")
    learnt = scratch.cut(contractions(v_tok, repairs, vocab, n_tok), "contractions")
    repairs = repairs.unionByName(learnt)

    # What each value's tokens weigh in the list, and what each entry gets of them.
    weight = vocab.groupBy("vocab", "name_id").agg(F.sum("w").alias("w")).groupBy("vocab").agg(F.max("w").alias("w"))
    known = repairs.where("sim >= 0.97").join(weight, "vocab").groupBy("token").agg(F.max("w").alias("w"))
    known = v_tok.where("span = 1").join(known, "token").groupBy("value").agg(F.collect_list(F.struct("pos", "w")).alias("known"))
    known = scratch.cut(known, "known")
    hits = v_tok.join(repairs, "token").join(vocab, "vocab")
    best = hits.groupBy("value", "name_id", "etok").agg(F.max_by(F.struct("w", "sim", "pos", "span"), F.struct(F.col("sim"), -F.col("span"), -F.col("pos"))).alias("m"))
    best = scratch.cut(best, "best")
    got = best.groupBy("value", "name_id").agg(F.sum(F.col("m.w") * F.col("m.sim")).alias("dot"), F.sum("m.w").alias("matched"), F.collect_list("m").alias("ms"))
    got = got.join(n_norm, "name_id").where(F.col("dot") >= threshold**2 * F.col("norm")).join(known, "value", "left")
    used = F.transform("ms", lambda m: m["pos"])
    also = F.transform("ms", lambda m: m["pos"] + m["span"] - 1)
    spare = F.aggregate(F.filter(F.coalesce("known", F.array().cast("array<struct<pos:int,w:double>>")), lambda k: ~F.array_contains(F.col("used"), k["pos"])), F.lit(0.0), lambda a, k: a + k["w"])
    got = got.withColumn("used", F.array_union(used, also)).withColumn("spare", spare)
    score = F.col("dot") / F.sqrt(F.col("norm") * (F.col("matched") + F.col("spare")))
    top = got.select("value", "ref_id", score.alias("score")).groupBy("value").agg(F.max_by(F.struct("ref_id", "score"), F.struct("score", -F.col("ref_id"))).alias("t"))
    out = v.select("value").join(scratch.cut(top, "top"), "value", "left")
    return out.select("value", F.when(F.col("t.score") >= threshold, F.col("t.ref_id")).otherwise(F.lit(0)).cast("bigint").alias("ref_id"), F.col("t.score").alias("score"))


def map_column(records: DataFrame, record_id: str, column: str, ref: DataFrame, ref_id: str, name: str, synonyms: str = "synonyms") -> DataFrame:
    """(field_name, record_id, ref_id) for each record whose value is neither blank nor exactly a canonical name."""
    rows = records.select(F.col(record_id).alias("record_id"), F.col(column).alias("value")).where(F.col("value").isNotNull() & F.col("value").rlike(r"[^\s\p{Z}]"))
    exact = ref.select(F.col(name).alias("value")).where("value is not null").distinct()
    rows = rows.join(exact, "value", "left_anti")
    mapped = map_values(rows, reference_names(ref, ref_id, name, synonyms))
    return rows.join(mapped, "value", "left").select(F.lit(column).alias("field_name"), "record_id", F.coalesce("ref_id", F.lit(0)).cast("bigint").alias("ref_id"))
