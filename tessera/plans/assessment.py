"""Queries over tests: constraints in plain words, grading, folders, intents, options, components of questions, elapsed times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import grading
from tessera.plans import learners
from tessera.sources.adapters import attempts, questions, table

SQL: dict[str, str] = {}


#: How requests go on, by the length of what they are about: numerals, what they name and rule out, how difficult.
_NUMERALS = ["十", "三", "十二", "二十", "两", "九十九", "七"]
_NAMED = ["选择题", "填空题和简答题", "题，不要选择题", "题，排除 填空", "multiple choice", "题"]
_LEVELS = ["基础", "", "Application", "计算", "understanding"]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, p): each first turn of a conversation as a request for questions about its first words."""
    n = F.length("text")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    many = F.when(n % 3 == 0, pick(_NUMERALS, n)).when(n % 3 == 1, (n % 47).cast("string")).otherwise("")
    about = F.regexp_replace(F.substring_index("text", " ", 2), r"[,.?!]", "")
    said = F.concat(F.lit("请出"), many, F.lit("道"), F.when(n % 4 > 0, F.lit("关于")).otherwise(""), about, F.lit("的"), pick(_LEVELS, n), pick(_NAMED, n))
    return table(spark, sf_dir, "conversations").where("turn = 0 AND text IS NOT NULL").select("conv_id", said.alias("p"))


def prompt_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests in plain words ask for."""
    d = _requests(spark, sf_dir)
    return d.select("conv_id", grading.question_count(F.col("p")).alias("n"), F.array_join(grading.question_types(F.col("p")), ",").alias("types"), grading.difficulty(F.col("p")).alias("difficulty"), grading.topic(F.col("p")).alias("topic"))


_HOLDS = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
_BARRED = lambda words: "(" + " OR ".join(f"regexp_matches(low, '(?:不要|不含|排除)\\s*[^，。；;]*{w}')" for w in words) + ")"
_TOPIC = r"(?:关于|有关|针对|围绕)\s*([^，。；;,.?？!！]{2,60}?)(?:的)?(?:题|题目|测试题|应用题|基础题|内容|方面)"
SQL["prompt_constraints"] = rf"""
WITH t AS (SELECT conv_id, text, length(text) AS n FROM conversations WHERE turn = 0 AND text IS NOT NULL),
p AS (SELECT conv_id, '请出' || CASE n % 3 WHEN 0 THEN {_NUMERALS!r}[n % {len(_NUMERALS)} + 1] WHEN 1 THEN (n % 47)::VARCHAR ELSE '' END || '道' || CASE WHEN n % 4 > 0 THEN '关于' ELSE '' END
  || regexp_replace(array_to_string(string_split(text, ' ')[1:2], ' '), '[,.?!]', '', 'g') || '的' || {_LEVELS!r}[n % {len(_LEVELS)} + 1] || {_NAMED!r}[n % {len(_NAMED)} + 1] AS p FROM t),
m AS (SELECT conv_id, p, lower(p) AS low, regexp_extract(p, '(\d+|[一两二三四五六七八九十]+)\s*(?:道|个|题)', 1) AS m FROM p),
c AS (SELECT *, CASE WHEN m = '十' THEN 10 WHEN contains(m, '十') THEN coalesce(nullif(instr('一二三四五六七八九', string_split(m, '十')[1]) * (string_split(m, '十')[1] <> '')::INT, 0), 1) * 10 + instr('一二三四五六七八九', string_split(m, '十')[2]) * (string_split(m, '十')[2] <> '')::INT
  WHEN m = '两' THEN 2 WHEN regexp_matches(m, '^[0-9]+$') THEN m::INT WHEN m <> '' THEN instr('一二三四五六七八九', m) END AS k FROM m),
y AS (SELECT *, [{", ".join(f"CASE WHEN {_HOLDS('low', w)} AND NOT {_BARRED(w)} THEN '{t}' END" for t, w in grading.TYPES.items())}] AS keep, [{", ".join(f"CASE WHEN NOT {_BARRED(w)} THEN '{t}' END" for t, w in grading.TYPES.items())}] AS rest,
  {" OR ".join(_HOLDS('low', w) for w in grading.TYPES.values())} AS named FROM c)
SELECT conv_id, CASE WHEN k > 0 THEN least(30, greatest(1, k)) ELSE 5 END::INT AS n, CASE WHEN NOT named THEN '{",".join(grading.TYPES)}' ELSE coalesce(nullif(array_to_string(list_filter(keep, lambda x: x IS NOT NULL), ','), ''), nullif(array_to_string(list_filter(rest, lambda x: x IS NOT NULL), ','), ''), 'short_answer') END AS types,
  CASE {" ".join(f"WHEN {_HOLDS('low', w)} THEN '{t}'" for t, w in grading.DIFFICULTIES.items())} ELSE 'understanding' END AS difficulty, trim(CASE WHEN regexp_matches(p, '{_TOPIC}') THEN regexp_extract(p, '{_TOPIC}', 1) ELSE p END) AS topic FROM y"""


def folder_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, folder): each document's text as a folder label, a part for each sentence."""
    return table(spark, sf_dir, "documents").select("doc_id", grading.folder(F.replace(F.col("text"), F.lit(". "), F.lit(" / "))).alias("folder"))


SQL["folder_labels"] = r"""
WITH p AS (SELECT doc_id, string_split(trim(trim(regexp_replace(replace(text, '. ', ' / '), '\s+', ' ', 'g')), '/'), '/') AS parts FROM documents)
SELECT doc_id, nullif(substring(array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '[\\/:*?"<>|]+', '-', 'g'), ' .-')), lambda x: x <> ''), '/'), 1, 160), '') AS folder FROM p"""


def folder_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(folder, n, last): documents by the first word of their folder, those without one in a group that comes last."""
    rows = folder_labels(spark, sf_dir).groupBy(F.coalesce(F.substring_index(F.substring_index("folder", "/", 1), " ", 1), F.lit("未分类")).alias("folder"))
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("last", F.col("folder") == "未分类")


SQL["folder_groups"] = f"WITH f AS ({SQL['folder_labels']}) SELECT coalesce(string_split(string_split(folder, '/')[1], ' ')[1], '未分类') AS folder, count(*) AS n, folder IS NULL AS last FROM f GROUP BY ALL"

#: Every word that tells an intent.
_WORDS = [w for words in grading.INTENTS.values() for w in words]


def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, intent): what turns ask for; each ends with three words that tell an intent, chosen by its length."""
    n = F.length("text")
    told = [F.element_at(F.array(*map(F.lit, _WORDS)), (n * k % len(_WORDS) + 1).cast("int")) for k in (1, 7, 11)]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", grading.intent(F.when(n % 5 == 0, F.col("text")).otherwise(F.concat_ws(" ", "text", *told))).alias("intent"))


_HITS = lambda words: " + ".join(f"contains(low, '{w}')::INT" for w in words)
SQL["question_intents"] = f"""
WITH w AS (SELECT conv_id, turn, text, length(text) AS n, {_WORDS!r} AS w FROM conversations), q AS (SELECT conv_id, turn, lower(coalesce(CASE WHEN n % 5 = 0 THEN text ELSE concat_ws(' ', text, w[n % {len(_WORDS)} + 1], w[n * 7 % {len(_WORDS)} + 1], w[n * 11 % {len(_WORDS)} + 1]) END, '')) AS low FROM w),
h AS (SELECT conv_id, turn, [{", ".join(f"({_HITS(words)})" for words in grading.INTENTS.values())}] AS h FROM q)
SELECT conv_id, turn, CASE WHEN list_max(h) > 0 THEN {list(grading.INTENTS)!r}[list_position(h, list_max(h))] ELSE 'general' END AS intent FROM h"""


_SMALL = "abcdefghijklmnopqrstuvwxyz"


def objective_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind, score, level): answers graded without a model; open questions stay ungraded.

    The answer is a document's first three words; what was given are its second to fourth, in capitals, or, for one in
    four, its last two.
    """
    n, w = F.col("doc_id"), F.split("text", " ")
    kind = F.element_at(F.array(*map(F.lit, ("multiple_choice", "fill_blank", "fill_blank", "short_answer"))), (n % 4 + 1).cast("int"))
    given = F.when(n % 8 < 6, F.translate(F.array_join(F.slice(w, 2, 3), "；"), _SMALL, _SMALL.upper())).otherwise(F.array_join(F.slice(F.reverse(w), 1, 2), "\n"))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", kind.alias("kind"), F.array_join(F.slice(w, 1, 3), ", ").alias("answer"), given.alias("given"))
    d = d.withColumn("share", grading.grade(F.col("kind"), F.col("answer"), F.col("given")))
    level = F.when(F.col("share") >= 0.85, "good").when(F.col("share") > 0, "partial").when(F.col("share").isNotNull(), "weak")
    return d.select("doc_id", "kind", F.round("share", 2).alias("score"), level.alias("level"))


_PLAIN = lambda x: rf"lower(trim(regexp_replace(regexp_replace({x}, '[#*_`>$\\{{}}\[\]().,，。；;：:！？!?-]', ' ', 'g'), '\s+', ' ', 'g')))"
_BLANKS = lambda x: rf"list_filter(list_transform(regexp_split_to_array({x}, '[,，;；\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"
SQL["objective_grades"] = rf"""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, ['multiple_choice', 'fill_blank', 'fill_blank', 'short_answer'][doc_id % 4 + 1] AS kind, array_to_string(w[1:3], ', ') AS answer, CASE WHEN doc_id % 8 < 6 THEN translate(array_to_string(w[2:4], '；'), '{_SMALL}', '{_SMALL.upper()}') ELSE array_to_string(list_reverse(w)[1:2], chr(10)) END AS given FROM w),
b AS (SELECT *, list_transform({_BLANKS('answer')}, lambda x: {_PLAIN('x')}) AS want, list_transform({_BLANKS('given')}, lambda x: {_PLAIN('x')}) AS got, upper(regexp_extract(answer, '([A-Ha-h])', 1)) AS x, upper(regexp_extract(given, '([A-Ha-h])', 1)) AS y FROM a),
s AS (SELECT doc_id, kind, CASE kind WHEN 'multiple_choice' THEN (x <> '' AND x = y)::INT::DOUBLE WHEN 'fill_blank' THEN CASE WHEN len(got) = 0 OR len(want) = 0 THEN 0.0::DOUBLE
  ELSE len(list_filter(want, lambda v: len(list_filter(got, lambda g: g <> '' AND v <> '' AND (g = v OR contains(v, g) OR contains(g, v)))) > 0))::DOUBLE / len(want) END END AS share FROM b)
SELECT doc_id, kind, round(share, 2) AS score, CASE WHEN share >= 0.85 THEN 'good' WHEN share > 0 THEN 'partial' WHEN share IS NOT NULL THEN 'weak' END AS level FROM s"""


def option_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, n_options): options among a turn's sentences, each on a line with a letter or something else before it."""
    marks = F.array(*map(F.lit, ("A. ", "b) ", "  C、\t", "D ", "", "e：  ", "I. ", "f:", "H) ")))
    lines = F.transform(F.split("text", r"\. "), lambda x, i: F.concat(F.element_at(marks, (i % 9 + 1).cast("int")), x))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(grading.options(F.array_join(lines, "\n"))).alias("n_options"))


SQL["option_lines"] = r"""
WITH l AS (SELECT conv_id, turn, string_split(array_to_string(list_transform(string_split(coalesce(text, ''), '. '), lambda x, i: ['A. ', 'b) ', '  C、' || chr(9), 'D ', '', 'e：  ', 'I. ', 'f:', 'H) '][(i - 1) % 9 + 1] || x), chr(10)), chr(10)) AS l, text FROM conversations)
SELECT conv_id, turn, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(l, lambda x: regexp_matches(trim(x, ' ' || chr(9) || chr(13)), '^[A-Ha-h][.)、:：]\s+'))) END::INT AS n_options FROM l"""


def component_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, kc): what a question is about, by page file, or by a part's name (the first by key), else as a file of that name."""
    n = F.col("event_id")
    about = F.when(n % 3 == 0, F.concat(F.lit("doc/"), (n % 50).cast("string"), F.lit(".md"))).when(n % 3 == 1, F.lit("red widget")).otherwise(F.concat(F.lit("unknown "), (n % 5).cast("string")))
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("about")).agg(F.min("p_partkey").cast("string").alias("node"))
    asked = table(spark, sf_dir, "events").select("event_id", about.alias("about"))
    file = F.when(F.endswith("about", F.lit(".md")), F.col("about")).otherwise(F.concat("about", F.lit(".md")))
    digest = F.substring(F.sha1(F.concat(F.lit("default:"), file).cast("binary")), 1, 12)
    return asked.join(names, "about", "left").select("event_id", F.when(F.endswith("about", F.lit(".md")), digest).otherwise(F.coalesce("node", digest)).alias("kc"))


SQL["component_keys"] = """
WITH a AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'doc/' || (event_id % 50) || '.md' WHEN 1 THEN 'red widget' ELSE 'unknown ' || (event_id % 5) END AS about FROM events),
n AS (SELECT p_name AS about, min(p_partkey)::VARCHAR AS node FROM part GROUP BY p_name)
SELECT event_id, CASE WHEN ends_with(a.about, '.md') THEN substring(sha1('default:' || a.about), 1, 12) ELSE coalesce(node, substring(sha1('default:' || a.about || '.md'), 1, 12)) END AS kc FROM a LEFT JOIN n ON a.about = n.about"""


def graded_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, i, part, score, level): the questions of each session beside its graded answers by place; unanswered ones score 0."""
    asked = questions(spark, sf_dir)
    order = Window.partitionBy("session_id").orderBy("number", "part", "score")
    places = asked.withColumn("i", F.row_number().over(order))
    given = places.where("number % 3 > 0").select("session_id", "i", "score")
    level = F.when(F.col("given") >= 0.85, "good").when(F.col("given") > 0, "partial").otherwise("weak")
    both = places.drop("score").join(given.withColumnRenamed("score", "given"), ["session_id", "i"], "left")
    return both.select("session_id", "i", "part", F.coalesce("given", F.lit(0.0)).alias("score"), level.alias("level"))


SQL["graded_sessions"] = f"""WITH {learners._Q}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY number, part, score)::INT AS i FROM q)
SELECT session_id, i, part, CASE WHEN number % 3 > 0 THEN score ELSE 0.0::DOUBLE END AS score, CASE WHEN number % 3 > 0 AND score >= 0.85 THEN 'good' WHEN number % 3 > 0 AND score > 0 THEN 'partial' ELSE 'weak' END AS level FROM n"""


def question_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, kc_id, questions, total, longest): seconds from a learner's first attempt on a component to each, added up as they are."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = attempts(spark, sf_dir).groupBy("user_id", "kc_id")
    exact = lambda c, digits: c.cast(f"decimal({digits},0)")  # noqa: E731 (a sum of microseconds soon is no long)
    passed = (F.sum(exact(at, 20)) - exact(F.count(F.lit(1)), 12) * exact(F.min(at), 20)).cast("double")
    return rows.agg(F.count(F.lit(1)).alias("questions"), F.round(passed / 1e6, 3).alias("total"), F.round((F.max(at) - F.min(at)) / 1e6, 3).alias("longest"))


SQL["question_times"] = f"WITH {learners._TRIES} SELECT user_id, kc_id, count(*) AS questions, round((sum(epoch_us(ts)) - count(*) * min(epoch_us(ts)))::BIGINT / 1000000.0::DOUBLE, 3) AS total, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE, 3) AS longest FROM a GROUP BY user_id, kc_id"

QUERIES = {f.__name__: f for f in (prompt_constraints, folder_labels, folder_groups, question_intents, objective_grades, option_lines, component_keys, graded_sessions, question_times)}
