"""Skill sets, overlap scores, recommendations and board statistics (the specified-only operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The skill names looked for in texts, and other ways to write some of them.
SKILLS = ("python", "sql", "java", "kotlin", "typescript", "javascript", "spreadsheets", "cloud hosting", "payroll checks", "stock control", "lesson planning", "site inspection")
ALIASES = {"py": "python", "js": "javascript", "ts": "typescript", "spreadsheet": "spreadsheets", "stock keeping": "stock control"}
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "we", "will", "with", "you", "your")


def tokens(c: Column) -> Column:
    """Lower case, letters and digits only, without stop words; NULL gives an empty list."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS))


def skill_pattern(name: str) -> str:
    """A whole-word pattern of a skill name."""
    return rf"(^|[^a-z0-9]){name}($|[^a-z0-9])"


def found_skills(c: Column) -> Column:
    """Names of the dictionary that occur in the text as whole words, aliases resolved, sorted and distinct."""
    low = F.lower(F.coalesce(c, F.lit("")))
    names = F.array(*[F.when(low.rlike(skill_pattern(s)), ALIASES.get(s, s)) for s in (*SKILLS, *ALIASES)])
    return F.array_sort(F.array_distinct(F.array_compact(names)))


def years(c: Column) -> Column:
    """The first number of years a text states; 0 without one."""
    return F.coalesce(F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"(\d{1,2})\+? years?", 1).try_cast("int"), F.lit(0))


def experience_score(have: Column, wanted: Column) -> Column:
    """100 if the years reach those wanted, else their share."""
    return F.when(wanted <= have, F.lit(100.0)).otherwise(F.round(have * F.lit(100.0) / wanted, 4))


def location_score(text: Column, location: Column) -> Column:
    """100 if the text names the location, 0 if not or if there is none."""
    place = F.lower(F.trim(F.coalesce(location, F.lit(""))))
    return F.when((place != "") & (place != "n/a") & F.contains(F.lower(F.coalesce(text, F.lit(""))), place), F.lit(100.0)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.round(F.size(F.array_intersect(a, b)) * F.lit(100.0) / union, 4)).otherwise(F.lit(0.0))


def coverage(have: Column, wanted: Column) -> Column:
    return F.when(F.size(wanted) > 0, F.round(F.size(F.array_intersect(have, wanted)) * F.lit(100.0) / F.size(wanted), 4)).otherwise(F.lit(0.0))


def composite(skill: Column, experience: Column, location: Column, weights: tuple[float, float, float] = (0.6, 0.25, 0.15)) -> Column:
    return F.round(sum((c * F.lit(w) for c, w in zip((skill, experience, location), weights, strict=True)), F.lit(0.0)), 4)


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int) -> DataFrame:
    """The n best rows of each group; WindowGroupLimit prunes map-side, so hot groups do not gather."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def job_skills(jobs: DataFrame) -> DataFrame:
    return jobs.select("internal_id", F.explode(found_skills(F.col("description"))).alias("skill"))


def skill_usage(bridge: DataFrame, skills: DataFrame) -> DataFrame:
    """``(skill, n)`` for every skill of the dictionary ``(skill)``, unused ones with 0."""
    used = bridge.groupBy("skill").agg(F.count(F.lit(1)).alias("n"))
    return skills.join(used, "skill", "left").select("skill", F.coalesce("n", F.lit(0)).alias("n"))


def text_rank(names: DataFrame, column: str) -> DataFrame:
    """Adds ``rank`` from 1 in binary order of a column of distinct texts: ranks within leading letters plus offsets, so that
    no task sees all texts."""
    lead = names.withColumn("_lead", F.substring(column, 1, 2))
    counts = lead.groupBy("_lead").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)  # one row for each pair of letters
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_lead").orderBy(column)).cast("bigint")
    return lead.withColumn("_r", inner).join(offsets, "_lead").withColumn("rank", F.col("_r") + F.col("_off")).drop("_lead", "_r", "_off")


def find_or_create(found: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names ``(name)`` against a table ``(id, name)`` without regard to case and outer blanks.

    Gives ``(name, id)`` of every distinct normalised name, and the rows to add: new names get the ids after the highest.
    """
    names = found.select(F.lower(F.trim("name")).alias("name")).filter("name <> ''").distinct()
    have = known.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("id").cast("bigint").alias("id"))
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
    created = text_rank(names.join(have, "name", "left_anti"), "name").select("name", (F.col("rank") + top).alias("id"))
    return names.join(have, "name").select("name", "id").unionByName(created), created


def incremental_matches(jobs: DataFrame, resumes: DataFrame, since: Column, n: int = 3) -> DataFrame:
    """The n best resumes ``(resume_id, have)`` of each job ``(internal_id, wanted)`` after ``since``.

    Pairs come from shared skills, not from a product; those without any are no matches.
    """
    new = jobs.filter(F.col("internal_id") > since)
    met = new.select("internal_id", "wanted", F.explode("wanted").alias("skill")).join(resumes.select("resume_id", "have", F.explode("have").alias("skill")), "skill").dropDuplicates(["internal_id", "resume_id"])
    scored = met.select("internal_id", "resume_id", jaccard(F.col("wanted"), F.col("have")).alias("score"))
    return top_n(scored, "internal_id", "score", "resume_id", n)


def tfidf_pairs(docs: DataFrame, key: str, threshold: float = 0.85) -> DataFrame:
    """``(a, b, score)``, a < b: pairs of documents ``(key, tokens)`` whose TF-IDF cosine reaches the threshold.

    Exact, by prefix filtering: a pair at the threshold shares a token among the rarest ones of each document, those whose
    weights the rest of the document cannot make up for. Candidates meet in these tokens alone.
    """
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    terms = docs.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(df, "token").select(key, "token", "df", (F.col("tf") * F.ln((total + 1) / F.col("df").cast("double"))).alias("w"))
    whole = Window.partitionBy(key)
    unit = weighted.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole)))
    rest = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("w") * F.col("w")).over(whole.orderBy("df", "token").rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    prefix = unit.withColumn("rest", rest).filter(F.col("rest") >= threshold - 1e-9).select(key, "token")
    vectors = unit.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("v"))
    a, b = prefix.select("token", F.col(key).alias("a")), prefix.select("token", F.col(key).alias("b"))
    met = a.join(b, "token").filter("a < b").select("a", "b").distinct()
    pairs = met.join(vectors.select(F.col(key).alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col(key).alias("b"), F.col("v").alias("vb")), "b")
    dot = F.aggregate(F.map_keys("va"), F.lit(0.0), lambda s, t: s + F.coalesce(F.element_at("va", t) * F.try_element_at(F.col("vb"), t), F.lit(0.0)))
    return pairs.select("a", "b", F.round(dot, 6).alias("score")).filter(F.col("score") >= threshold)


def merge_skill(bridge: DataFrame, old: str, new: str) -> DataFrame:
    """Rewrite one skill to another in a bridge table and drop the repeats this makes."""
    return bridge.withColumn("skill", F.when(F.col("skill") == old, new).otherwise(F.col("skill"))).distinct()


def scored_applications(applications: DataFrame, jobs: DataFrame, resumes: DataFrame) -> DataFrame:
    """Overlap of job and resume skills for each application that names both."""
    d, t = F.col("description"), F.col("text")
    job = jobs.select(F.col("internal_id").alias("job_id"), found_skills(d).alias("wanted"), years(d).alias("years_wanted"), "location")
    resume = resumes.select(F.col("doc_id").alias("resume_id"), found_skills(t).alias("have"), years(t).alias("years_had"), "text")
    return applications.join(job, "job_id").join(resume, "resume_id")


def first_applications(applications: DataFrame) -> DataFrame:
    """One row per (user, job): the lowest application id, by a mergeable aggregate."""
    return applications.groupBy("user_id", "job_id").agg(F.min("id").alias("id"))


def tfidf_scores(docs: DataFrame, key: str, query: list[str]) -> DataFrame:
    """Cosine of each document ``(key, tokens)`` with a query, in TF-IDF weights over all documents.

    Document counts and lengths are grouped aggregates; only rows that share a token with the query are scored.
    """
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    terms = docs.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("token", F.ln((total + 1) / (F.col("df") + 1).cast("double")).alias("idf"))
    weighted = terms.join(idf, "token").select(key, "token", (F.col("tf") * F.col("idf")).alias("w"))
    length = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len")).filter("len > 0")
    q = idf.filter(F.col("token").isin(query))
    norm = q.agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("qlen")).scalar()
    hits = weighted.join(F.broadcast(q), "token").groupBy(key).agg(F.sum(F.col("w") * F.col("idf")).alias("dot"))
    return hits.join(length, key).select(key, F.round(F.col("dot") / (F.col("len") * norm), 6).alias("score"))
