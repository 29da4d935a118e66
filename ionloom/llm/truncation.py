"""Texts that were cut off before their end, found by what usually follows their last words, in SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.session import cut

#: A word is frequent if this share of all words (and two) are it: at most 1 / FREQUENT words are. Every other word, and any over LONG characters, is one class, RARE.
FREQUENT, LONG = 2.8e-5, 64
#: An n-gram tells something from this many occurrences inside texts.
SUPPORT = 5
#: It is "almost never terminal" if at most this share of its occurrences ends a sentence, a line or a text.
TERMINAL_SHARE = 0.05
#: A length is a source's limit if this share of its texts (and SUPPORT texts) has it, ten times more than lengths just below it.
LIMIT_SHARE, LIMIT_PEAK = 0.01, 10.0

_MARKS = r"(?:[\s\u00a0]|\[(?:\.\.\.|…)\]|\.\.\.|…|\ufffd)+$"
_LETTER = r"[\p{L}\p{M}\p{N}#&&[^\p{IsHan}]]"
_TOKEN = rf"\p{{IsHan}}|{_LETTER}+(?:[-.,_/’\x27]{_LETTER}+)*[-/’\x27]?|\n|[^\s]"


def _tokens(body: str) -> str:
    """Text to tokens: lower case, numbers by shape (the first run of digits of a word is #, later digits are 9), line breaks kept."""
    plain = rf"regexp_replace(regexp_replace(lower({body}), r'\s*\n\s*', '\n'), r'\d', '9')"
    return rf"regexp_extract_all(regexp_replace({plain}, r'(?<!9)(?<![\p{{L}}\p{{N}}][-.,/’])9+', '#'), r'{_TOKEN}', 0)"


#: Every text once, tokenised without marks of a cut at its end; only texts that may have some are searched for them.
#: explode(array(x)) names x, so that it is computed once a text, however often it is used.
_TEXTS = rf"""
SELECT doc_id, source, IF(body = '', NULL, {_tokens('body')}) AS tokens, body = text AND body RLIKE r'[0-9][.]$' AS dotted, text RLIKE r'\ufffd\s*$' AS broken,
       xxhash64(text) AS hash, length(text) AS chars, octet_length(text) AS bytes
FROM @docs
LATERAL VIEW explode(array(
  IF(right(text, 3) = '...' OR right(text, 1) IN (' ', '\n', '\t', '\r', '\u00a0', '\u000b', '\u000c', ']', '…', '\ufffd'), regexp_replace(text, r'{_MARKS}', ''), text))) b AS body
WHERE text IS NOT NULL
"""

#: Counts of every class with the four before it, inside texts, and of those before the end of a sentence, line or text.
_GRAMS = """
SELECT p[i] AS c4, p[i + 1] AS c3, p[i + 2] AS c2, p[i + 3] AS c1, p[i + 4] AS c0, count(*) AS n, count_if(p[i + 5] IN {ends}) AS ends
FROM (SELECT size(classes) AS n, concat(array('^', '^', '^', '^'), classes, array('$')) AS p FROM @classed WHERE size(classes) > 1)
LATERAL VIEW explode(sequence(0, n - 2)) s AS i
GROUP BY ALL
"""

_STOPS = "('.', '?', '!', '。', '？', '！')"
_ENDS = "('.', '?', '!', '。', '？', '！', '\\n')"


def _sql(text: str, **frames: DataFrame) -> DataFrame:
    """The query ``text`` with @name standing for a DataFrame."""
    spark = next(iter(frames.values())).sparkSession
    views = {name: f"{name}_{uuid.uuid4().hex}" for name in frames}
    for name, df in frames.items():
        df.createOrReplaceTempView(views[name])
        text = re.sub(rf"@{name}\b", views[name], text)
    out = spark.sql(text)
    for view in views.values():
        spark.catalog.dropTempView(view)
    return out


def _classes(tokens: Column, frequent: list[str]) -> Column:
    """The class of each word: the word itself if frequent or without a letter, else RARE."""
    return F.transform(tokens, lambda w: F.when(w.isin(frequent) | ~w.rlike(r"\p{L}"), w).otherwise("RARE"))


def _continued(words: DataFrame, begun: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, w0, <name>): for each begun word w0, how often (n) words w with the same ``keys`` go on after it.

    Words give at most LONG beginnings, however long they are; longer begun words are compared with the words that share
    their first LONG characters.
    """
    firsts = words.where(F.length("w") > 1).select(*keys, "n", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("w") - 1, F.lit(LONG - 1))), lambda i: F.substring("w", F.lit(1), i))).alias("w0"))
    short = firsts.groupBy(*keys, "w0").agg(F.sum("n").alias(name)).join(begun.where(F.length("w0") < LONG), [*keys, "w0"], "left_semi")
    head = lambda c: F.substring(c, 1, LONG).alias("head")
    long = words.where(F.length("w") > LONG).select(*keys, "n", "w", head("w")).join(begun.where(F.length("w0") >= LONG).select(*keys, "w0", head("w0")), [*keys, "head"])
    long = long.where(F.col("w").startswith(F.col("w0")) & (F.length("w") > F.length("w0"))).groupBy(*keys, "w0").agg(F.sum("n").alias(name))
    return short.unionByName(long)


def _inside(grams: DataFrame, order: int) -> DataFrame:
    """Per n-gram of classes: n, its occurrences inside texts and at ends of texts; ends, those that end a sentence, line or text."""
    key = ", ".join(f"c{k}" for k in reversed(range(order)))
    return _sql(f"SELECT {key}, sum(n) AS n, sum(ends) AS ends, sum(inner) AS inner FROM @grams GROUP BY {key}", grams=grams)


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, reason): the texts that stop before their end, each once.

    Word n-grams are counted inside all texts and at the ends of sentences, lines and texts. Of a text without final
    punctuation, ellipsis marks aside, the last trigram of word classes is joined with the counts:

    - ``trigram``: it is frequent inside texts and, the text itself aside, almost never terminal. Where the trigram in
      a longer context of up to five words has enough support and is almost never or mostly terminal, that decides;
      where it lacks support or is neither, the bigram does, then the word. A word after which texts or sentences mostly end in its four-word context is no cut, whatever it is.
    - ``word``: the trigram is hardly ever seen, but frequent ones continue its last word or number; or the last word
      never stands inside a text while longer words begin with it.
    - ``limit``: the text is as long (in characters or bytes) as its source's limit, a length at which texts pile up.
    - ``bytes``: it ends inside a character (with a replacement character).

    Null, empty and blank texts are no cases. Repeated doc_ids come out once. Texts of a null source have no limit.
    Texts are tokenised once, whole, and stored. The frequent words are collected: at most 1 / FREQUENT of at most LONG characters.
    """
    texts = cut(_sql(_TEXTS, docs=documents.select("doc_id", "source", "text")))
    told = texts.where("tokens is not null")
    words = cut(_sql("SELECT w, count(*) AS n, count_if(pos < size - 1) AS inner FROM (SELECT size(tokens) AS size, posexplode(tokens) AS (pos, w) FROM @told) GROUP BY w", told=told))
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = sorted(r.w for r in words.where((F.col("n") >= max(2.0, FREQUENT * total)) & (F.length("w") <= LONG)).select("w").collect())
    inside = cut(_sql(_GRAMS.format(ends=_ENDS), classed=told.select(_classes(F.col("tokens"), frequent).alias("classes"))))

    last = _sql(
        f"""
        SELECT doc_id, source, broken, hash, chars, bytes, dotted, slice(p, -5, 5) AS p, element_at(p, -1) AS w0
        FROM (SELECT *, concat(array('^', '^', '^', '^', '^'), IF(dotted, slice(near, 1, size(near) - 1), near)) AS p FROM (SELECT *, slice(tokens, greatest(1, size(tokens) - 5), 6) AS near FROM @told))
        WHERE element_at(p, -1) NOT IN {_STOPS}""",
        told=told,
    )
    classed = last.withColumn("p", _classes(F.col("p"), frequent))
    finals = cut(classed.select("doc_id", "source", "broken", "hash", "chars", "bytes", "dotted", "w0", *[F.col("p")[4 - k].alias(f"c{k}") for k in range(5)]))
    # at ends of texts, copies of a text count once
    counted = _sql(
        "SELECT c4, c3, c2, c1, c0, n, ends, n AS inner FROM @inside UNION ALL SELECT c4, c3, c2, c1, c0, count(*), count(*), 0L FROM (SELECT DISTINCT hash, c4, c3, c2, c1, c0 FROM @finals) GROUP BY ALL",
        inside=inside,
        finals=finals,
    )
    looked = finals
    for order in (5, 4, 3, 2, 1):
        keys = [f"c{k}" for k in range(order)]
        known = _inside(counted, order).withColumnsRenamed({"n": f"n{order}", "ends": f"ends{order}", "inner": f"inner{order}"})
        looked = looked.join(known, keys, "left")
    after = _sql("SELECT c4, c3, c2, c1, sum(n) AS nw, sum(ends) AS endsw FROM @counted GROUP BY ALL", counted=counted)
    looked = looked.join(after, ["c4", "c3", "c2", "c1"], "left")
    # frequent words that begin with the last one, in the same context
    continuing = _sql("SELECT c2, c1, c0 AS w, sum(n) AS n FROM @counted WHERE c0 <> 'RARE' GROUP BY c2, c1, c0", counted=counted)
    looked = looked.join(_continued(continuing, finals.select("c2", "c1", "w0").distinct(), ["c2", "c1"], "longer"), ["c2", "c1", "w0"], "left")
    # any words that begin with the last one, where that never stands inside a text
    stems = _sql(r"SELECT DISTINCT w0 FROM @finals WHERE w0 RLIKE r'\p{L}[-/’\x27]?$|#[-/]$'", finals=finals)
    inner = words.where("inner > 0").select("w", F.col("inner").alias("n"))
    unseen = stems.join(inner.select(F.col("w").alias("w0")), "w0", "left_anti")
    looked = looked.join(_continued(inner, unseen, [], "begun"), "w0", "left")
    lengths = _sql(
        """
        SELECT source, unit, size, count(*) AS n FROM (
          SELECT source, stack(2, 'chars', chars, 'bytes', bytes) AS (unit, size) FROM @texts WHERE source IS NOT NULL AND chars > 0)
        GROUP BY source, unit, size""",
        texts=texts,
    )
    limits = _sql(
        f"""
        SELECT source, unit, size FROM (
          SELECT *, sum(n) OVER (PARTITION BY source, unit) AS all_n, coalesce(sum(n) OVER w, 0) AS below, coalesce(sum(n) OVER a, 0) AS above FROM @lengths
          WINDOW w AS (PARTITION BY source, unit ORDER BY size RANGE BETWEEN 50 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY source, unit ORDER BY size RANGE BETWEEN 9 FOLLOWING AND UNBOUNDED FOLLOWING))
        WHERE n >= {SUPPORT} AND n >= {LIMIT_SHARE} * all_n AND n >= {LIMIT_PEAK} * below / 50.0 AND above <= 0.1 * n""",
        lengths=lengths,
    )
    by_chars, by_bytes = (limits.where(F.col("unit") == u).select("source", F.col("size").alias(u), F.lit(True).alias(f"at_{u}")).distinct() for u in ("chars", "bytes"))
    looked = looked.join(by_chars, ["source", "chars"], "left").join(by_bytes, ["source", "bytes"], "left")
    cut_word = f"longer >= {SUPPORT} AND (c0 = 'RARE' OR n3 - 1 <= {TERMINAL_SHARE} * longer)"
    return _sql(
        f"""
        SELECT doc_id, any_value(source) AS source, min(reason) AS reason FROM (
          SELECT doc_id, source, CASE
              WHEN broken THEN 'bytes'
              WHEN dotted THEN CASE WHEN {cut_word} THEN 'word' END
              WHEN at_chars OR at_bytes THEN 'limit'
              WHEN {cut_word} THEN 'word'
              WHEN begun >= 2 THEN 'word'
              WHEN nw > {SUPPORT} AND 2 * (endsw - 1) >= nw - 1 THEN NULL
              WHEN inner5 >= {SUPPORT} AND ends5 - 1 <= {TERMINAL_SHARE} * (n5 - 1) THEN 'trigram'
              WHEN n5 > {SUPPORT} AND 2 * (ends5 - 1) >= n5 - 1 THEN NULL
              WHEN inner4 >= {SUPPORT} AND ends4 - 1 <= {TERMINAL_SHARE} * (n4 - 1) THEN 'trigram'
              WHEN n4 > {SUPPORT} AND 2 * (ends4 - 1) >= n4 - 1 THEN NULL
              WHEN inner3 >= {SUPPORT} AND ends3 - 1 <= {TERMINAL_SHARE} * (n3 - 1) THEN 'trigram'
              WHEN n3 > {SUPPORT} AND 2 * (ends3 - 1) >= n3 - 1 THEN NULL
              WHEN c0 <> 'RARE' AND inner2 >= {SUPPORT} AND ends2 - 1 <= {TERMINAL_SHARE} * (n2 - 1) THEN 'trigram'
              WHEN n2 > {SUPPORT} AND 2 * (ends2 - 1) >= n2 - 1 THEN NULL
              WHEN c0 <> 'RARE' AND inner1 >= {SUPPORT} AND ends1 - 1 <= {TERMINAL_SHARE} * (n1 - 1) THEN 'trigram'
              WHEN n1 > {SUPPORT} AND 2 * (ends1 - 1) >= n1 - 1 THEN NULL
            END AS reason FROM @looked)
        WHERE reason IS NOT NULL GROUP BY doc_id""",
        looked=looked,
    )


def truncation_by_source(documents: DataFrame) -> DataFrame:
    """(source, texts, truncated, share): how often each source truncates; texts are those that aren't null or blank."""
    texts = documents.where(F.trim("text") != "").groupBy("source").agg(F.count("*").alias("texts"))
    cuts = truncated(documents).groupBy(F.col("source").alias("s")).agg(F.count("*").alias("truncated"))
    return texts.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "texts", F.coalesce("truncated", F.lit(0)).alias("truncated"), F.round(F.coalesce("truncated", F.lit(0)) / F.col("texts"), 6).alias("share"))
