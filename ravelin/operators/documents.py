"""Ranked search in documents: passages, BM25, vectors, fusion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window as W, functions as F

K1, B, RRF = 1.5, 0.75, 60
PASSAGE_CHARS, LEAST_CHARS = 1200, 40
# Words without content, left out of the index.
STOPWORDS = frozenset("a an and are as at be by for from has have in is it its of on or that the this to was were what which who will with".split())


def words(c):
    """Lower-case words of letters and digits, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: ~w.isin(*sorted(STOPWORDS)))


def chunks(text: str, most: int = PASSAGE_CHARS, least: int = LEAST_CHARS) -> list[tuple[str, str]]:
    """(heading path, passage) of a Markdown text: paragraphs joined up to a size, tiny ones with the one before."""
    out: list[tuple[str, str]] = []
    path: list[str] = []
    open_: list[str] = []

    def close() -> None:
        body = "\n\n".join(open_).strip()
        open_.clear()
        if not body:
            return
        head = " > ".join(path)
        if len(body) < least and out and out[-1][0] == head:
            out[-1] = (head, out[-1][1] + "\n\n" + body)
        else:
            out.append((head, body))

    for block in re.split(r"\n\s*\n|(?=^#{1,6} )|(?<=\n)(?=#{1,6} )", text):
        block = block.strip()
        m = re.match(r"(#{1,6}) +(.*)", block)
        if m:
            close()
            level = len(m[1])
            title, _, rest = block[m.start(2) :].partition("\n")
            path[level - 1 :] = [title.strip()]
            block = rest.strip()
        if not block:
            continue
        if open_ and sum(map(len, open_)) + len(block) > most:
            close()
        open_.append(block)
    close()
    return out


def passages(spark, folder: str) -> DataFrame:
    """(source, heading, passage, text) of all .md and .txt files below a folder, read by Spark."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt}").option("wholetext", "true").text(folder).select(F.input_file_name().alias("source"), F.col("value").alias("text"))

    @F.udf("array<struct<heading:string,text:string>>")
    def cut(text):
        return chunks(text or "")

    return files.select("source", F.posexplode(cut("text")).alias("passage", "c")).select("source", "c.heading", "passage", "c.text")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, tf, length): the index, a row for each word of each document."""
    d = docs.select(F.col(key), words(F.col(text)).alias("w")).withColumn("length", F.size("w"))
    return d.select(key, "length", F.explode("w").alias("word")).groupBy(key, "length", "word").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, question: str, n: int = 10) -> DataFrame:
    """(key, score): the documents that answer a question best, ties by key.

    Only the question's words are looked for: documents are filtered and counted where they are, and no index is shuffled.
    """
    terms = sorted({w for w in re.findall(r"[^\W_]+", question.lower()) if w not in STOPWORDS})
    d = docs.select(F.col(key), words(F.col(text)).alias("w"))
    d = d.withColumn("length", F.size("w")).withColumn("tf", F.array(*[F.size("w") - F.size(F.array_remove("w", t)) for t in terms])).drop("w")
    stats = d.agg(F.count(F.lit(1)).alias("N"), F.avg("length").alias("mean"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))])
    d = d.where(F.exists("tf", lambda x: x > 0)).join(F.broadcast(stats))
    parts = [F.log(1 + (F.col("N") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col("tf")[i] * (K1 + 1) / (F.col("tf")[i] + K1 * (1 - B + B * F.col("length") / F.col("mean"))) for i in range(len(terms))]
    return d.select(key, sum(parts, F.lit(0.0)).alias("score")).orderBy(F.desc("score"), key).limit(n)


def cosine_top(vectors: DataFrame, key: str, vector: str, query: list[float], n: int = 10) -> DataFrame:
    """(key, score): the vectors of the smallest angle to the query; zero vectors score 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    length = sum(x * x for x in query) ** 0.5
    score = F.coalesce(F.try_divide(dot, size * F.lit(length)), F.lit(0.0))
    return vectors.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(n)


def fused(a: DataFrame, b: DataFrame, key: str, n: int = 10, k: int = RRF) -> DataFrame:
    """(key, score): two short rankings as one, by the sum of 1 / (k + rank)."""
    rank = lambda d: d.where("score > 0").withColumn("r", F.row_number().over(W.orderBy(F.desc("score"), key)))
    x, y = rank(a).select(key, F.col("r").alias("ra")), rank(b).select(key, F.col("r").alias("rb"))
    d = x.join(y, key, "full")
    score = F.coalesce(1 / (k + F.col("ra")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("rb")), F.lit(0.0))
    return d.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(n)


def coverage(question: str, passages_: list[str], idf: dict[str, float]) -> float:
    """The share of a question's words, by weight, that the passages hold."""
    terms = {w for w in re.findall(r"[^\W_]+", question.lower()) if w not in STOPWORDS}
    held = {w for p in passages_ for w in re.findall(r"[^\W_]+", p.lower())}
    whole = sum(idf.get(t, 1.0) for t in terms)
    return sum(idf.get(t, 1.0) for t in terms & held) / whole if whole else 0.0


def grounded(text: str, facts: list[str]) -> bool:
    """Whether all numbers of a text beyond 10 stand in its facts."""
    number = re.compile(r"-?\d[\d,]*\.?\d*")
    plain = lambda s: {x.replace(",", "").rstrip(".") for x in number.findall(s)}
    known = set().union(*map(plain, facts)) if facts else set()
    return all(x in known or abs(float(x)) <= 10 for x in plain(text) if x not in ("", "-"))


def save_index(spark, folder: str, path: str) -> str:
    """Writes the passages and postings of a folder's documents; returns the fingerprint that names this state of it."""
    p = passages(spark, folder)
    p.write.mode("overwrite").parquet(f"{path}/passages")
    kept = spark.read.parquet(f"{path}/passages").withColumn("id", F.concat_ws("#", "source", "passage"))
    postings(kept, "id", "text").write.mode("overwrite").parquet(f"{path}/postings")
    return fingerprint(spark, folder)


def fingerprint(spark, folder: str) -> str:
    """A value that changes when any document's path, size or time does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt}").load(folder).select("path", "length", "modificationTime")
    return str(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


def search_index(spark, path: str, question: str, n: int = 6) -> DataFrame:
    """(id, score): BM25 from saved postings; only the question's words are read (the filter reaches the files)."""
    terms = sorted({w for w in re.findall(r"[^\W_]+", question.lower()) if w not in STOPWORDS})
    all_ = spark.read.parquet(f"{path}/postings")
    size = all_.select("id", "length").distinct().agg(F.count(F.lit(1)).alias("N"), F.avg("length").alias("mean"))
    hits = all_.where(F.col("word").isin(terms))
    df = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    d = hits.join(F.broadcast(df), "word").join(F.broadcast(size))  # as many rows as the question has words, and one
    part = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return d.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(n)


def topic_vectors(docs: DataFrame, key: str, text: str, size: int = 32, vocabulary: int = 4096):
    """(model, key and ``vector``): texts as points in a space of topics: weighted word counts and their main directions.

    Counts and weights are fitted over all documents; the directions come from the Gram matrix of the vocabulary, which
    is of a fixed size.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, PCA, CountVectorizer, Normalizer

    d = docs.select(key, words(F.col(text)).alias("_words")).where(F.size("_words") > 0)
    steps = [CountVectorizer(inputCol="_words", outputCol="_tf", vocabSize=vocabulary, minDF=2), IDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="_unit"), PCA(inputCol="_unit", outputCol="vector", k=size)]
    model = Pipeline(stages=steps).fit(d)
    return model, model.transform(d).select(key, "vector")


def best_sentences(question: str, hits: list[tuple[str, str]], most: int = 3) -> list[tuple[str, str]]:
    """(sentence, source) of retrieved passages that answer a question best; earlier passages count a little more."""
    terms = {w for w in re.findall(r"[^\W_]+", question.lower()) if w not in STOPWORDS}
    scored = []
    for place, (source, passage) in enumerate(hits):
        for sentence in re.split(r"(?<=[.!?])\s+", passage):
            held = {w for w in re.findall(r"[^\W_]+", sentence.lower())}
            if terms & held:
                scored.append((len(terms & held) / max(1, len(terms)) - 0.15 * place, sentence.strip(), source))
    scored.sort(key=lambda x: -x[0])
    return [(s, source) for v, s, source in scored if v >= 0.6 * scored[0][0]][:most]


def cited(answer: str, hits: dict[str, str], least: float = 0.4) -> list[str]:
    """What is wrong with an answer's citations: sentences without one, with numbers or words that the passage lacks."""
    out = []
    for sentence in re.split(r"(?<=[.!?\]])\s+", answer.strip()):
        names = re.findall(r"\[([^\]]+)\]", sentence)
        known = [hits[n] for n in names if n in hits]
        if not known:
            out.append(f"no citation: {sentence}")
            continue
        text, body = " ".join(known).lower(), re.sub(r"\[[^\]]+\]", "", sentence).lower()
        if any(n not in text for n in re.findall(r"\d+(?:\.\d+)?", body)):
            out.append(f"number not in the passage: {sentence}")
        said = {w for w in re.findall(r"[^\W\d_]+", body) if w not in STOPWORDS}
        if said and sum(w in text for w in said) < least * len(said):
            out.append(f"not what the passage says: {sentence}")
    return out
