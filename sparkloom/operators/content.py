"""Search in chunks of files: postings by field, exact names, paths, and their fusion.

A chunk is (path, ordinal, heading, text, names).  Words are compared by stem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..storage import stage

# fixed values: a word's further weight in a heading and in a path, an exact name's points, words that a hit must hold, the least share of the best score
HEADING, PATH, NAMED, LEAST_WORDS, FLOOR = 0.5, 0.4, 2.5, 2, 0.3
# fixed values: a word in more than this share of all chunks weighs nothing; one in so few chunks is enough by itself
GENERIC, RARE = 0.5, 3
# fixed values: points of a file found by its number, by two words of its path, by one that few paths share, and how few
NUMBERED, TWO_WORDS, ONE_WORD, FEW_PATHS = 5.0, 1.0, 0.4, 3
MOST_WORDS, MOST_NAMES, GRAM = 10, 20, 4


def question_words(questions: DataFrame) -> DataFrame:
    """q, term, pos: the stems of each question's significant terms, each once."""
    words = questions.select("q", F.posexplode(t.significant_terms(F.col("text"), 48)).alias("pos", "word"))
    return words.groupBy("q", t.stem(F.col("word")).alias("term")).agg(F.min("pos").alias("pos"))


def question_names(questions: DataFrame) -> DataFrame:
    """q, name: the first names of each question that look like identifiers, by an underscore, a dot or a hump."""
    like = F.filter(t.names(F.col("text")), lambda w: w.rlike("[A-Za-z0-9]_[A-Za-z0-9]|[.]|[a-z][A-Z]"))
    return questions.select("q", F.explode(F.slice(like, 1, MOST_NAMES)).alias("name"))


def field_postings(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """path, ordinal, term, in_heading, in_path: one row for each chunk and stem, of the stems in ``terms`` alone.

    Heading and path are part of what a chunk holds.  Every chunk is tokenised once, a field's different words alone become rows, and
    rows of other stems go before the shuffle.
    """

    def words(c: str, heading: bool, path: bool) -> Column:
        return F.struct(F.array_distinct(t.tokens(F.coalesce(F.col(c), F.lit("")))).alias("words"), F.lit(heading).alias("h"), F.lit(path).alias("p"))

    # fields are rows before their words are, so that no word carries a struct of its own
    fields = chunks.select("path", "ordinal", F.inline(F.array(words("text", False, False), words("heading", True, False), words("path", False, True))))
    held = t.of_stems(fields.select("path", "ordinal", F.explode("words").alias("w"), "h", "p"), "w", terms)
    return held.groupBy("path", "ordinal", "term").agg(F.max("h").alias("in_heading"), F.max("p").alias("in_path"))


def word_weights(words: DataFrame, postings: DataFrame, chunks: DataFrame) -> DataFrame:
    """q, term, idf, rare: each question's heaviest words, of those that aren't in most chunks."""
    total = chunks.agg(F.count("*").alias("total"))
    frequency = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))  # one row
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rated = words.join(frequency.where(F.col("df") <= F.col("total") * GENERIC), "term").withColumn("idf", idf)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("idf", 9)), "pos"))
    return rated.select("q", "term", "idf", (F.col("df") <= RARE).alias("rare"), place.alias("place")).where(F.col("place") <= MOST_WORDS).drop("place")


def scored_chunks(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """q, path, ordinal, n_words, n_rare, named, score of every chunk that holds a weighing word or a name of the question."""
    words = stage(question_words(questions), "words")
    postings = stage(field_postings(chunks, words), "postings")
    weights = stage(word_weights(words, postings, chunks), "weights")
    factor = 1 + F.when(F.col("in_heading"), HEADING).otherwise(0.0) + F.when(F.col("in_path"), PATH).otherwise(0.0)
    by_word = postings.join(weights, "term").select("q", "path", "ordinal", F.lit(1).alias("word"), F.col("rare").cast("int").alias("rare"), F.lit(0).alias("named"), (F.col("idf") * factor).alias("points"))
    names = question_names(questions)
    mentioned = chunks.select("path", "ordinal", F.explode("names").alias("name")).join(names, "name").select("q", "path", "ordinal").distinct()
    by_name = mentioned.select("q", "path", "ordinal", F.lit(0).alias("word"), F.lit(0).alias("rare"), F.lit(1).alias("named"), F.lit(NAMED).alias("points"))
    hits = by_word.unionByName(by_name).groupBy("q", "path", "ordinal").agg(
        F.sum("word").alias("n_words"), F.sum("rare").alias("n_rare"), F.max("named").alias("named"), F.round(F.sum("points"), 6).alias("score")
    )
    known = weights.groupBy("q").agg(F.count("*").alias("known"))
    return hits.join(known, "q", "left").withColumn("known", F.coalesce("known", F.lit(0)))


def content_search(chunks: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """q, path, ordinal, n_words, matches, score, rank: the best chunk of each file, the best k files of each question (q, text).

    ``matches`` counts the file's chunks with a hit.  A hit stays if it has FLOOR of the question's best score and two of its
    weighing words (all, if there are fewer), a rare one, or a name.  Equal scores go by more matches, then by path; within a file to
    the first chunk.  Questions without words or names, and an empty table, have no rows.
    """
    file = Window.partitionBy("q", "path")
    best = scored_chunks(chunks, questions).withColumn("matches", F.count("*").over(file)).withColumn("of_file", F.row_number().over(file.orderBy(F.desc("score"), "ordinal"))).where("of_file = 1")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("matches"), "path"))).where(F.col("rank") <= k)
    top = F.max("score").over(Window.partitionBy("q"))
    enough = (F.col("n_words") >= F.greatest(F.lit(1), F.least(F.lit(LEAST_WORDS), F.col("known")))) | (F.col("n_rare") > 0) | (F.col("named") > 0)
    return ranked.withColumn("top", top).where((F.col("score") >= FLOOR * F.col("top")) & enough).select("q", "path", "ordinal", "n_words", "matches", "score", "rank")


def path_hits(paths: DataFrame, questions: DataFrame) -> DataFrame:
    """q, path, numbered, terms: files whose lower-cased path holds a stem of the question, or the number of a decision it names.

    ``terms`` are the question's stems that match a word of the path.  Stems meet paths in their first GRAM letters, which every stem
    has, and words in theirs, so that no question is held against all paths; a path is cut into words, and each stemmed, once.
    """
    asked = stage(questions.select("q", t.query_terms(F.col("text"), 24).alias("stems"), t.document_numbers(F.col("text")).alias("numbers")), "asked")
    stems = asked.select("q", F.posexplode("stems").alias("pos", "stem"))
    wanted = stems.select("stem", F.substring("stem", 1, GRAM).alias("gram")).distinct()
    low = F.lower("path")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("path") - GRAM + 1))
    grams = paths.select("path", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM))))).alias("gram"))
    by_word = grams.join(wanted, "gram").where(low.contains(F.col("stem"))).select("path", "stem").join(stems.select("q", "stem"), "stem")
    number = F.regexp_extract(low, "(?:^|/)(?:adr[-_ ]?)?0*([0-9]+)[-_. ][^/]*$", 1)
    of_decision = low.rlike("(^|/)((adrs?|decisions?|rfcs?)/|adr[-_ ]?)0*[0-9]+[-_. ][^/]*$")
    by_number = paths.select("path", number.alias("number"), of_decision.alias("found")).join(asked.select("q", F.explode("numbers").alias("number")), "number")
    words = paths.select("path", F.explode(t.tokens(F.translate("path", "/.-", "   "))).alias("word")).select("path", t.stem(F.col("word")).alias("word")).distinct()
    # stems have GRAM letters at least, and match words that share these
    alike = words.withColumn("gram", F.substring("word", 1, GRAM)).join(wanted, "gram").where(t.stems_match(F.col("stem"), F.col("word")))
    covered = alike.select("path", "stem").distinct().join(stems, "stem")

    def of(rows: DataFrame, found: Column, numbered: int, term: Column) -> DataFrame:
        return rows.select("q", "path", found.alias("found"), F.lit(numbered).alias("numbered"), term.alias("term"))

    none = F.lit(None).cast("struct<pos:int,stem:string>")
    every = of(by_word, F.lit(True), 0, none).unionByName(of(by_number, F.col("found"), 1, none)).unionByName(of(covered, F.lit(False), 0, F.struct("pos", "stem")))
    each = every.groupBy("q", "path").agg(F.max("found").alias("found"), F.max("numbered").alias("numbered"), F.sort_array(F.collect_set("term")).alias("terms"))
    return each.where("found").select("q", "path", "numbered", F.col("terms.stem").alias("terms"))


def name_bonus(hits: DataFrame) -> DataFrame:
    """q, path, bonus of files found by their paths."""
    each = hits.select("q", "path", F.explode("terms").alias("term"))
    shared = each.groupBy("q", "term").agg(F.count("*").alias("n_paths"))
    first = hits.select("q", "path", "numbered", F.size("terms").alias("n"), F.get("terms", F.lit(0)).alias("term"))
    points = F.when(F.col("n") >= 2, TWO_WORDS).when((F.col("n") == 1) & (F.col("n_paths") <= FEW_PATHS), ONE_WORD).otherwise(0.0)
    rated = first.join(shared, ["q", "term"], "left").select("q", "path", (points + F.col("numbered") * NUMBERED).alias("bonus"))
    return rated.where("bonus > 0")


def content_retriever(chunks: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """q, path, score, rank: hits by text as a share of the question's best, and points for the file's name; the best k."""
    by_text = content_search(chunks, questions, 2 * k)
    top = F.max("score").over(Window.partitionBy("q"))
    rated = by_text.select("q", "path", (F.col("score") / top).alias("points"))
    by_name = name_bonus(path_hits(chunks.select("path").distinct(), questions)).select("q", "path", F.col("bonus").alias("points"))
    total = rated.unionByName(by_name).groupBy("q", "path").agg(F.round(F.sum("points"), 6).alias("score"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "path"))).where(F.col("rank") <= k)
