"""Practice sets: which generated questions are usable, marks of answers, totals. Expressions on one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

TOTAL_MARKS = 10
# Kinds of questions.
CHOICE_TYPES = ("mcq", "true_false")


def normalise(sets: DataFrame, *keep: str) -> DataFrame:
    """The usable questions of sets (qtype, questions: array of struct of question, options, correct_index,
    explanation, model_answer, rubric (array of point, marks) and source_pages, all text).

    A question keeps its place in the list. One without text is left out; a choice needs two options and a correct
    one among them, a written question a rubric. Rubric marks that don't add up to ten are scaled, each rounded half
    to even to a tenth, so that the sum may differ a little.
    """
    q = sets.select(*keep, "qtype", F.posexplode("questions").alias("position", "q"))
    stripped = lambda c: T.strip(F.coalesce(c, F.lit("")))
    options = F.filter(F.transform(F.coalesce("q.options", F.array().cast("array<string>")), stripped), lambda o: o != "")
    rubric = F.filter(F.transform(F.col("q.rubric"), lambda r: F.struct(stripped(r["point"]).alias("point"), F.coalesce(r["marks"], F.lit("0")).try_cast("double").alias("marks"))), lambda r: (r["point"] != "") & r["marks"].isNotNull())
    rows = q.select(*keep, "qtype", "position", stripped(F.col("q.question")).alias("question"), F.lit(TOTAL_MARKS).alias("max_marks"), F.transform(F.filter(F.coalesce("q.source_pages", F.array().cast("array<string>")), lambda p: p.rlike(r"^(?U)\d+$")), lambda p: p.cast("int")).alias("source_pages"), F.col("qtype").isin(*CHOICE_TYPES).alias("is_choice"), options.alias("options"), F.coalesce(F.col("q.correct_index").try_cast("int"), F.lit(-1)).alias("correct_index"), T.blank_to_null(T.strip(F.col("q.explanation"))).alias("explanation"), T.blank_to_null(T.strip(F.col("q.model_answer"))).alias("model_answer"), F.coalesce(rubric, F.array().cast("array<struct<point:string,marks:double>>")).alias("rubric"))
    usable = F.when(F.col("is_choice"), (F.size("options") >= 2) & F.col("correct_index").between(0, F.size("options") - 1)).otherwise(F.size("rubric") > 0)
    rows = rows.where((F.col("question") != "") & usable)
    choice = F.col("is_choice")
    return rows.select(*keep, "qtype", "position", "question", "max_marks", "source_pages", F.when(choice, F.transform("options", lambda o, i: F.struct(i.alias("index"), o.alias("text")))).alias("options"), F.when(choice, F.col("correct_index")).alias("correct_index"), F.when(choice, F.col("explanation")).alias("explanation"), F.when(~choice, F.col("model_answer")).alias("model_answer"), F.when(~choice, rescaled(F.col("rubric"))).alias("rubric"))


def half_even(x: Column, places: int = 1) -> Column:
    """Rounded half to even, as decimals."""
    return F.bround(x.cast("decimal(38,12)"), places).cast("double")


def rescaled(rubric: Column) -> Column:
    """Marks scaled to a sum of ten, unless they have it or have none."""
    total = F.aggregate(rubric, F.lit(0.0), lambda acc, r: acc + r["marks"])
    scaled = F.transform(rubric, lambda r: F.struct(r["point"].alias("point"), half_even(r["marks"] * TOTAL_MARKS / total).alias("marks")))
    return F.when((total > 0) & (F.abs(total - TOTAL_MARKS) > 0.01), scaled).otherwise(rubric)


def mark_choice(answers: DataFrame) -> DataFrame:
    """``answers`` (selected_index, correct_index, max_marks, explanation) with is_correct, marks and feedback.

    An answer without a choice has no mark and a reject_reason. No or zero max_marks count as 1.
    """
    most = F.when(F.coalesce("max_marks", F.lit(0)) == 0, 1).otherwise(F.col("max_marks"))
    right = F.coalesce(F.col("selected_index") == F.col("correct_index"), F.lit(False))
    given = F.col("selected_index").isNotNull()
    return answers.withColumn("is_correct", F.when(given, right)).withColumn("marks", F.when(given, F.when(right, most).otherwise(0)).cast("decimal(6,2)")).withColumn("feedback", F.when(given, F.coalesce(T.blank_to_null(F.col("explanation")), F.when(right, "Correct.").otherwise("Not correct; see the explanation.")))).withColumn("reject_reason", F.when(~given, "selected_index"))


def mark_written(answers: DataFrame) -> DataFrame:
    """``answers`` (answer_text, rubric, judged: array of awarded_marks and feedback, max_marks) with results by place
    and marks: each award within 0 and its point's marks, a missing one 0, the sum within 0 and max_marks."""
    given = T.blank_to_null(F.col("answer_text")).isNotNull()
    most = F.when(F.coalesce("max_marks", F.lit(0)) == 0, 1).otherwise(F.col("max_marks")).cast("double")
    judged = F.slice(F.coalesce(F.col("judged"), F.array().cast("array<struct<awarded_marks:double,feedback:string>>")), F.lit(1), F.size("rubric"))
    results = F.zip_with("rubric", judged, lambda r, j: F.struct(r["point"].alias("point"), F.greatest(F.lit(0.0), F.least(r["marks"], F.coalesce(j["awarded_marks"], F.lit(0.0)))).alias("awarded_marks"), r["marks"].alias("max_marks"), F.coalesce(j["feedback"], F.lit("")).alias("feedback")))
    total = F.aggregate("rubric_results", F.lit(0.0), lambda acc, r: acc + r["awarded_marks"])
    rows = answers.withColumn("rubric_results", F.when(given, results))
    return rows.withColumn("marks", F.when(given, F.greatest(F.lit(0.0), F.least(most, total))).cast("decimal(6,2)")).withColumn("reject_reason", F.when(~given, "answer_text"))


def totals(answers: DataFrame, by: str) -> DataFrame:
    """Marks, possible marks and percentage of each ``by``; 0 where nothing could be had."""
    return answers.groupBy(by).agg(F.sum(F.coalesce("marks", F.lit(0))).alias("marks"), F.sum("max_marks").alias("max_marks")).withColumn("pct", F.when(F.col("max_marks") > 0, F.round(F.col("marks") * 100 / F.col("max_marks"), 2).cast("double")).otherwise(F.lit(0.0)))


def saved(sets: DataFrame, questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """``questions`` (set_id, seq, qtype, ...) of the ``sets`` (set_id, session_id, user_id) whose session is the
    user's, with the set's user, their place from 1 in order of seq, and the kind of the first for all.

    A set is one request to a model, so its questions are few. Those of a set of another's session aren't saved.
    """
    own = sets.join(sessions.select("session_id", "user_id").distinct(), ["session_id", "user_id"], "left_semi").select("set_id", "user_id")
    order = Window.partitionBy("set_id").orderBy("seq")
    return questions.join(own, "set_id").withColumn("position", F.row_number().over(order)).withColumn("qtype", F.first("qtype").over(order))


def practice_view(sets: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions of each set with their answer, if any; the correct option is shown only once answered."""
    joined = sets.join(questions, "set_id").join(answers, "question_id", "left")
    return joined.withColumn("correct_index", F.when(F.col("answer_id").isNotNull(), F.col("correct_index")))
