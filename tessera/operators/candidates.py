"""Relations that an ontology allows between the atoms of a text: what a model is asked to confirm or reject.

Atoms are found in texts by automata, and not where they lie inside a longer atom. Two atoms that share a
sentence, or stand within 700 characters, make a hypothesis for each relation that their types allow, or a plain
one. Atoms that nothing connects get one by type alone. Of each text's hypotheses a number stays, those first that
are the first to name one of their atoms.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import markup
from tessera.operators.shared import written

#: Types of atoms, of relations, and other names for them. Unknown ones count as concept and related.
NODE_TYPES = [
    "concept", "formula", "mechanism", "property", "material", "composition", "structure", "processing",
    "instrument", "algorithm", "descriptor", "dataset", "failure_mode", "case", "safety_rule",
]
EDGE_TYPES = [
    "has_composition", "composition_to_structure", "processed_by", "results_in_structure", "determines_property", "explained_by",
    "measured_by", "characterized_by", "modeled_by", "predicted_by", "uses_descriptor", "leads_to_failure", "diagnosed_by",
    "prevented_by", "safety_constraint_of", "supports_course", "prerequisite", "related",
]
NODE_ALIASES = {
    "course": "concept", "knowledge": "concept", "term": "concept", "definition": "concept", "principle": "mechanism", "theory": "mechanism", "process": "processing",
    "experiment": "case", "example": "case", "method": "algorithm", "model": "algorithm", "software": "algorithm", "data": "dataset", "database": "dataset",
    "device": "instrument", "equipment": "instrument", "failure": "failure_mode", "safety": "safety_rule", "rule": "safety_rule", "microstructure": "structure", "phase": "structure", "performance": "property",
}
EDGE_ALIASES = {
    "has_chemical_composition": "has_composition", "processing_to_structure": "results_in_structure", "structure_to_property": "determines_property", "mechanism_to_property": "determines_property",
    "property_to_failure": "leads_to_failure", "instrument_to_observable": "measured_by", "method_to_measurement": "measured_by", "algorithm_to_prediction": "predicted_by", "model_to_property": "modeled_by",
    "descriptor_to_model": "uses_descriptor", "failure_to_diagnosis": "diagnosed_by", "course_support": "supports_course", "prerequisite_of": "prerequisite", "related_to": "related", "see_also": "related",
}
#: Which types a relation may lead from and to. Other relations may lead anywhere.
DIRECTIONS = {
    "has_composition": (["material"], ["composition"]),
    "composition_to_structure": (["composition"], ["structure"]),
    "processed_by": (["material"], ["processing"]),
    "results_in_structure": (["processing"], ["structure"]),
    "determines_property": (["structure", "mechanism"], ["property"]),
    "explained_by": (["property", "failure_mode"], ["mechanism"]),
    "measured_by": (["property"], ["instrument", "algorithm"]),
    "characterized_by": (["structure", "failure_mode"], ["instrument", "algorithm", "property"]),
    "modeled_by": (["property", "concept"], ["algorithm"]),
    "predicted_by": (["property"], ["algorithm"]),
    "uses_descriptor": (["algorithm"], ["descriptor"]),
    "leads_to_failure": (["property", "mechanism", "concept", "processing", "material"], ["failure_mode"]),
    "diagnosed_by": (["failure_mode"], ["instrument", "algorithm"]),
    "prevented_by": (["failure_mode"], ["processing", "material", "concept", "safety_rule"]),
    "safety_constraint_of": (["safety_rule"], ["processing", "case"]),
}
#: Relations that are supposed between two types, and how specific each is.
SUPPOSED = {
    ("material", "composition"): [("has_composition", 0.90)],
    ("composition", "structure"): [("composition_to_structure", 0.90)],
    ("material", "processing"): [("processed_by", 0.88)],
    ("processing", "structure"): [("results_in_structure", 0.90)],
    ("structure", "property"): [("determines_property", 0.92)],
    ("mechanism", "property"): [("determines_property", 0.90)],
    ("property", "mechanism"): [("explained_by", 0.88)],
    ("property", "instrument"): [("measured_by", 0.90)],
    ("property", "algorithm"): [("modeled_by", 0.84), ("predicted_by", 0.84)],
    ("structure", "instrument"): [("characterized_by", 0.88)],
    ("algorithm", "descriptor"): [("uses_descriptor", 0.82)],
    ("property", "failure_mode"): [("leads_to_failure", 0.88)],
    ("mechanism", "failure_mode"): [("leads_to_failure", 0.88)],
    ("concept", "failure_mode"): [("leads_to_failure", 0.76)],
    ("processing", "failure_mode"): [("leads_to_failure", 0.74)],
    ("material", "failure_mode"): [("leads_to_failure", 0.74)],
    ("failure_mode", "mechanism"): [("explained_by", 0.88)],
    ("failure_mode", "property"): [("characterized_by", 0.84)],
    ("failure_mode", "instrument"): [("diagnosed_by", 0.86)],
    ("failure_mode", "safety_rule"): [("prevented_by", 0.80)],
    ("failure_mode", "algorithm"): [("diagnosed_by", 0.82)],
    ("failure_mode", "processing"): [("prevented_by", 0.84)],
    ("failure_mode", "material"): [("prevented_by", 0.80)],
    ("safety_rule", "processing"): [("safety_constraint_of", 0.86)],
    ("safety_rule", "case"): [("safety_constraint_of", 0.82)],
}
#: Scores. A reversed relation counts less; plain ones by where they were found; weights and bounds.
REVERSED, IN_SENTENCE, NEARBY, BY_TYPE_ALONE = 0.92, 0.52, 0.42, 0.35
SPECIFIC, SENTENCE_BONUS, OTHER_BONUS, NEARNESS, REACH, MOST = 0.55, 0.24, 0.08, 0.22, 1000.0, 0.95
#: Characters between atoms that are near, around what is quoted, and of a quote; hypotheses of a text; headings whose sections say nothing.
NEAR, AROUND, QUOTE, KEPT = 700, 120, 360, 48
SILENT = ("关联知识", "相关知识", "进一步问题")
_HEADING = re.compile(r"^#{1,6}\s+(.+?)\s*$")
_SENTENCE = re.compile("[^\n。！？；;!?]+[。！？；;!?]?")


def node_type(found: Column) -> Column:
    """A stated type of an atom as one of NODE_TYPES."""
    return _known(found, NODE_ALIASES, NODE_TYPES, "concept")


def edge_type(found: Column) -> Column:
    """A stated type of a relation as one of EDGE_TYPES."""
    return _known(found, EDGE_ALIASES, EDGE_TYPES, "related")


def _known(found: Column, aliases: dict[str, str], types: list[str], other: str) -> Column:
    plain = F.translate(F.lower(F.trim(F.regexp_replace(F.coalesce(found, F.lit("")), r"(?U)\s+", " "))), "- ", "__")
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[plain], plain)
    return F.when(named.isin(types), named).otherwise(other)


def direction_holds(kind: Column, source_type: Column, target_type: Column) -> Column:
    """Whether a relation may lead from one type of atom to another."""
    rules = [F.when((kind == k) & ~(source_type.isin(a) & target_type.isin(b)), False) for k, (a, b) in DIRECTIONS.items()]
    return F.coalesce(*rules, F.lit(True))


def masked(text: str) -> str:
    """A text with headings and silent sections as spaces, every other character where it was."""
    out, silent = [], False
    for line in text.splitlines(keepends=True):
        head = _HEADING.match(line.strip())
        if head:
            silent = head.group(1) in SILENT
        out.append(" " * len(line) if head or silent else line)
    return "".join(out)


def lowered(text: str) -> str:
    """A text in lower case, with as many characters: one that would become two stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def clear_spans(text: str, automaton, atoms: list[tuple[int, int]], owners: list[list[int]]) -> dict[int, list[tuple[int, int]]]:
    """Spans of each atom, without those inside a span of an atom with a longer label.

    ``automaton`` finds terms by number; ``owners`` are the atoms of each term, ``atoms`` each one's longest term and
    longest form of its label. Places of one term don't overlap, as in a search from left to right.
    """
    found: dict[int, set] = {}
    ends: dict[int, int] = {}
    for last, (term, size) in automaton.iter(text):
        start = last + 1 - size
        if start >= ends.get(term, 0):
            ends[term] = last + 1
            for atom in owners[term]:
                found.setdefault(atom, set()).add((start, last + 1))
    longest = sorted((-atoms[a][1], a) for a in found)
    out, starts, reach, at = {}, [], [], 0
    held: list[tuple[int, int]] = []
    for size, atom in sorted((-atoms[a][0], a) for a in found):
        # spans of atoms whose label is longer than anything this one is called
        grown = False
        while at < len(longest) and longest[at][0] < size:
            held.extend(found[longest[at][1]])
            at, grown = at + 1, True
        if grown:
            held.sort()
            starts, reach = [s for s, _ in held], np.maximum.accumulate([e for _, e in held]).tolist()
        spans = [(s, e) for s, e in sorted(found[atom]) if not ((k := bisect_right(starts, s)) and reach[k - 1] >= e)]
        if spans:
            out[atom] = spans
    return out


def nearest(spans: dict[int, list[tuple[int, int]]], within: int | None = None) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(distance, place of the first, of the second) for each two atoms, by where they start: the nearest places, the first such ones.

    Places are passed in order; each looks back at the last place of every other atom, so only neighbours are compared.
    """
    last: dict[int, int] = {}
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for start, atom in sorted((s, a) for a, own in spans.items() for s, _ in own):
        for other, place in list(last.items()):
            if within is not None and start - place > within:
                del last[other]
            elif other != atom:
                pair, places = ((atom, other), (start, place)) if atom < other else ((other, atom), (place, start))
                out[pair] = min(out.get(pair, (1 << 60, 0, 0)), (start - place, *places))
        last[atom] = start
    return out


#: What a task holds of made rows, by characters; a pair counts as so many.
HELD, PAIR_SIZE = 4_000_000, 100
_PAIR = "struct<unit:int,a:int,b:int,distance:int,start:int,end:int>"


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import ahocorasick

    for frame in frames:
        rows, size = [], 0
        for doc, text, terms, names, labels in frame[["doc", "text", "terms", "names", "labels"]].itertuples(index=False):
            text = masked(text or "")
            low, numbers, owners = lowered(text), {}, []
            for atom, own in enumerate(terms):
                for term in own:
                    if term:
                        k = numbers.setdefault(term, len(numbers))
                        if k == len(owners):
                            owners.append([])
                        owners[k].append(atom)
            pairs = []
            if len(terms) > 1 and numbers:
                automaton = ahocorasick.Automaton()
                for term, k in numbers.items():
                    automaton.add_word(term, (k, len(term)))
                automaton.make_automaton()
                sizes = list(zip((int(x) for x in names), (int(x) for x in labels), strict=True))
                for unit, m in enumerate(_SENTENCE.finditer(text)):
                    start = m.start() + len(m.group()) - len(m.group().lstrip())
                    said = m.group().strip()
                    for (a, b), (d, *_) in nearest(clear_spans(low[start : start + len(said)], automaton, sizes, owners)).items() if said else ():
                        pairs.append((unit, a, b, d, start, start + len(said)))
                for (a, b), (d, x, y) in nearest(clear_spans(low, automaton, sizes, owners), NEAR).items():
                    pairs.append((-1, a, b, d, min(x, y), max(x, y)))
            rows.append((doc, text, pairs))
            size += len(text) + PAIR_SIZE * len(pairs)
            if size >= HELD:
                yield pd.DataFrame(rows, columns=["doc", "masked", "pairs"])
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=["doc", "masked", "pairs"])


def _hypotheses() -> list[tuple]:
    """(type_a, type_b, h, typed, forward, kind, specificity) of two atoms, the first one before the second."""
    out = []
    for a in NODE_TYPES:
        for b in NODE_TYPES:
            found = [(True, True, k, s) for k, s in SUPPOSED.get((a, b), [])] + [(True, False, k, s * REVERSED) for k, s in SUPPOSED.get((b, a), [])]
            out.extend((a, b, h, *x) for h, x in enumerate(found or [(False, True, "related", 0.0)]))
    return out


def relation_candidates(texts: DataFrame, nodes: DataFrame, most: int = KEPT) -> DataFrame:
    """(doc, place, source, target, edge_type, evidence, score, reason): up to ``most`` hypotheses of each text, by score, labels and type.

    ``texts`` (doc, text), one row for each text; ``nodes`` (doc, place, node, label, node_type, source_term): its
    atoms, in their order (place, unlike within a text), looked for by forms of label and source_term. Both are matched by doc; null
    ones match nothing. Atoms of a text without mention, and of a null or empty text, are connected by type alone. A text with one atom gives none.

    Where scores are even, what was met first goes first: sentences, then the whole text, then types alone, each in
    order of sentence, first and second atom and relation. A hypothesis is kept in the first go if no better one names
    its source, or none its target; these are found by the least rank of each atom, so no order has to be walked.
    """
    spark = texts.sparkSession
    forms = F.array_distinct(F.concat(markup.label_variants(F.col("label")), markup.label_variants(F.col("source_term"))))
    size = lambda of: F.coalesce(F.array_max(F.transform(of, lambda x: F.length(x))), F.lit(0))
    atom = F.struct("place", "node", "label", node_type(F.col("node_type")).alias("type"), forms.alias("terms"), size(forms).alias("named"), size(markup.label_variants(F.col("label"))).alias("labelled"))
    held = nodes.where("doc IS NOT NULL").groupBy("doc").agg(F.array_sort(F.collect_list(atom)).alias("atoms"))  # what one text names
    both = written(texts.where("doc IS NOT NULL").select("doc", "text").join(held, "doc"), "atoms-of-texts")
    asked = both.select("doc", "text", F.col("atoms.terms").alias("terms"), F.col("atoms.named").alias("names"), F.col("atoms.labelled").alias("labels"))
    doc = dict(texts.dtypes)["doc"]
    met = written(asked.mapInPandas(_pairs, f"doc {doc}, masked string, pairs array<{_PAIR}>"), "atom-pairs")
    table = F.broadcast(spark.createDataFrame(_hypotheses(), "type_a string, type_b string, h int, typed boolean, forward boolean, kind string, specificity double"))  # of fixed size

    few = both.select("doc", F.transform("atoms", lambda x: F.struct(x["node"].alias("node"), x["label"].alias("label"), x["type"].alias("type"))).alias("atoms"))
    pairs = met.select("doc", F.explode("pairs").alias("p")).join(few, "doc")
    at = lambda c: F.get("atoms", F.col(c))
    pairs = pairs.select("doc", "p.*", at("p.a").alias("x"), at("p.b").alias("y"), (F.col("p.unit") >= 0).alias("said"))
    nearness = F.greatest(F.lit(0.0), 1.0 - F.col("distance") / REACH) * NEARNESS
    place = F.struct(F.when(F.col("said"), 0).otherwise(1).alias("phase"), "unit", "a", "b", "h")
    specificity = F.when(F.col("typed"), F.col("specificity")).when(F.col("said"), IN_SENTENCE).otherwise(NEARBY)
    where = F.when(F.col("said"), "same-sentence co-occurrence").otherwise("nearby document mentions")
    found = pairs.join(table, (F.col("x.type") == F.col("type_a")) & (F.col("y.type") == F.col("type_b"))).select(
        "doc",
        F.when(F.col("forward"), F.col("x")).otherwise(F.col("y")).alias("from"),
        F.when(F.col("forward"), F.col("y")).otherwise(F.col("x")).alias("to"),
        F.col("kind").alias("edge_type"),
        F.round(F.least(F.lit(MOST), specificity * SPECIFIC + F.when(F.col("said"), SENTENCE_BONUS).otherwise(OTHER_BONUS) + nearness), 3).alias("score"),
        F.concat(where, F.when(F.col("typed"), " + type-compatible relation").otherwise("")).alias("reason"),
        place.alias("seen"),
        "start",
        "end",
    )
    found = found.where("from.node <> to.node")
    best = F.struct((-F.col("score")).alias("loss"), "seen", "reason", "start", "end")
    made = found.groupBy("doc", "from", "to", "edge_type").agg(F.min(best).alias("best"), F.min("seen").alias("seen"))
    made = written(made.select("doc", "from", "to", "edge_type", (-F.col("best.loss")).alias("score"), "best.reason", "seen", "best.start", "best.end", F.col("best.seen.phase").alias("phase")), "hypotheses")

    # atoms that nothing names yet: the first other atom of the text that their type is supposed to relate to, or any
    named = made.select("doc", F.explode(F.array("from.node", "to.node")).alias("node")).distinct()
    alone = both.select("doc", F.posexplode("atoms").alias("k", "u"), "atoms").withColumn("node", F.col("u.node")).join(named, ["doc", "node"], "left_anti")
    linked = {a: [b for b in NODE_TYPES if (a, b) in SUPPOSED or (b, a) in SUPPOSED] for a in NODE_TYPES}
    allowed = F.create_map(*[v for a, bs in linked.items() for v in (F.lit(a), F.array(*map(F.lit, bs)) if bs else F.array().cast("array<string>"))])
    others = F.filter("atoms", lambda x: x["node"] != F.col("node"))
    peers = F.filter(others, lambda x: F.array_contains(allowed[F.col("u.type")], x["type"]))
    peer = F.coalesce(F.get(peers, F.lit(0)), F.get(others, F.lit(0)))
    bare = lambda c: F.struct(F.col(f"{c}.node").alias("node"), F.col(f"{c}.label").alias("label"), F.col(f"{c}.type").alias("type"))
    alone = alone.withColumn("p", peer).where("p IS NOT NULL").join(table.where("h = 0"), (F.col("u.type") == F.col("type_a")) & (F.col("p.type") == F.col("type_b")))
    alone = alone.select(
        "doc",
        F.when(F.col("forward"), bare("u")).otherwise(bare("p")).alias("from"),
        F.when(F.col("forward"), bare("p")).otherwise(bare("u")).alias("to"),
        F.col("kind").alias("edge_type"),
        F.round(F.least(F.lit(MOST), F.when(F.col("typed"), F.col("specificity")).otherwise(BY_TYPE_ALONE) * SPECIFIC + OTHER_BONUS), 3).alias("score"),
        F.concat(F.when(F.col("typed"), "type-compatible").otherwise("type-agnostic"), F.lit(" fallback; verify against the full excerpt")).alias("reason"),
        F.struct(F.lit(2).alias("phase"), F.lit(0).alias("unit"), F.col("k").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("h")).alias("seen"),
        F.lit(0).alias("start"),
        F.lit(0).alias("end"),
        F.lit(2).alias("phase"),
    )
    alone = alone.groupBy("doc", "from", "to", "edge_type").agg(F.min_by(F.struct("score", "reason", "start", "end", "phase"), F.struct((-F.col("score")).alias("loss"), "seen")).alias("b"), F.min("seen").alias("seen"))
    alone = alone.select("doc", "from", "to", "edge_type", "b.score", "b.reason", "seen", "b.start", "b.end", "b.phase")
    every = made.unionByName(alone)

    ranked = written(every.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "seen"))), "ranked-hypotheses")
    first = ranked.select("doc", "rank", F.explode(F.array("from.node", "to.node")).alias("node")).groupBy("doc", "node").agg(F.min("rank").alias("rank")).select("doc", "rank").distinct()
    chosen = ranked.join(first.withColumn("first", F.lit(0)), ["doc", "rank"], "left")
    chosen = chosen.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy(F.coalesce("first", F.lit(1)), "rank"))).where(F.col("k") <= most)
    chosen = chosen.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "from.label", "to.label", "edge_type", "rank")))
    return chosen.join(met.select("doc", "masked"), "doc").select("doc", "place", F.col("from.node").alias("source"), F.col("to.node").alias("target"), "edge_type", _quote().alias("evidence"), "score", "reason")


def repaired_relations(stated: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc, place, source, target, edge_type, evidence, confidence, weight): stated relations as edges that the ontology allows.

    ``stated`` (doc, place, source, target, edge_type, evidence, confidence): what a model said of a text, in its order,
    by ids or labels of ``nodes`` (doc, place, node, label, node_type), whatever their case and spaces; of names that
    several atoms have, the last one counts. Relations with an unknown end are left out. A plain relation takes the type
    that ``candidates`` (doc, place, source, target, edge_type) has for its pair: that of the last candidate in
    its direction, else of the first one in the other. A relation whose direction its type forbids is turned round, or
    becomes a plain one if neither is allowed. Of equal edges the first stays. Confidence is held between 0 and 1, .7 if missing.
    """
    clean = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))
    names = nodes.select("doc", "node", node_type(F.col("node_type")).alias("type"), F.posexplode(F.array(F.lower("node"), F.lower("label"), clean(F.col("label")))).alias("k", "name"), "place")
    names = names.where("name <> ''").groupBy("doc", "name").agg(F.max_by(F.struct("node", "type"), F.struct("place", "k")).alias("x"))
    ends = [names.select("doc", F.col("name").alias(f"{c}_name"), F.col("x.node").alias(c), F.col("x.type").alias(f"{c}_type")) for c in ("source", "target")]
    rows = stated.select("doc", "place", clean(F.col("source")).alias("source_name"), clean(F.col("target")).alias("target_name"), edge_type(F.col("edge_type")).alias("kind"), "evidence", "confidence")
    rows = rows.join(ends[0], ["doc", "source_name"]).join(ends[1], ["doc", "target_name"])
    told = candidates.select("doc", "place", "source", "target", edge_type(F.col("edge_type")).alias("found"))
    both = told.withColumn("direct", F.lit(1)).unionByName(told.select("doc", "place", F.col("target").alias("source"), F.col("source").alias("target"), "found", F.lit(0).alias("direct")))
    there, back = F.col("direct") == 1, F.col("direct") == 0
    both = both.groupBy("doc", "source", "target").agg(F.coalesce(F.max_by(F.when(there, F.col("found")), F.when(there, F.col("place"))), F.min_by(F.when(back, F.col("found")), F.when(back, F.col("place")))).alias("found"))
    rows = rows.join(both, ["doc", "source", "target"], "left")
    allows = lambda kind: direction_holds(kind, F.col("source_type"), F.col("target_type"))
    turns = lambda kind: direction_holds(kind, F.col("target_type"), F.col("source_type"))
    better = (F.col("kind") == "related") & F.col("found").isNotNull() & (allows(F.col("found")) | turns(F.col("found")))
    rows = rows.withColumn("kind", F.when(better, F.col("found")).otherwise(F.col("kind")))
    kind = F.col("kind")
    turned = ~allows(kind) & turns(kind)
    rows = rows.select(
        "doc",
        "place",
        F.when(turned, F.col("target")).otherwise(F.col("source")).alias("source"),
        F.when(turned, F.col("source")).otherwise(F.col("target")).alias("target"),
        F.when(allows(kind) | turns(kind), kind).otherwise("related").alias("edge_type"),
        F.trim(F.regexp_replace(F.coalesce("evidence", F.lit("")), r"(?U)\s+", " ")).alias("evidence"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.7)))).alias("confidence"),
    )
    first = rows.groupBy("doc", "source", "target", "edge_type").agg(F.min(F.struct("place", "evidence", "confidence")).alias("e"))
    return first.select("doc", "e.place", "source", "target", "edge_type", "e.evidence", "e.confidence", F.round(0.2 + F.col("e.confidence") * 0.8, 3).alias("weight"))


def _quote() -> Column:
    """The sentence, or what stands around two places, shortened; nothing for types alone."""
    text, n = F.col("masked"), F.length("masked")
    centre = F.floor((F.col("start") + F.col("end")) / 2)
    left, right = F.greatest(F.lit(0), centre - AROUND), F.least(n, centre + AROUND)
    around = F.trim(F.regexp_replace(F.substring(text, (left + 1).cast("int"), (right - left).cast("int")), r"(?U)\s+", " "))
    around = F.concat(F.when(left > 0, "...").otherwise(""), around, F.when(right < n, "...").otherwise(""))
    said = F.substring(text, F.col("start") + 1, F.col("end") - F.col("start"))
    return F.substring(F.when(F.col("phase") == 0, said).when(F.col("phase") == 1, around).otherwise(""), 1, QUOTE)
