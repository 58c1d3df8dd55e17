"""Secret scans: fixed rules, and automata inferred from the credentials that the rules find."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .automata import END, Automaton, classes, follow
from .common import stage, text_or_empty

#: Fixed by contract: the kinds in their order, with the least length that counts.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: The kind of a span that only the automata found.
LEARNT = "learnt"
#: What may be a credential: a run of the characters they are made of, from the least labelled length on.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: A place of a prefix tree is a state of its own where this share of its automaton's strings, and two at least, pass it.
SHARE = 1 / 1000
#: Beyond so many symbols a place needs in proportion more, so one long token that is repeated is no chain of states.
DEPTH = 64
#: Steps of scores that are told apart where a threshold is looked for.
STEP = 1e-4
#: Natural logarithm by which a whole token has to be likelier as a credential than as an ordinary
#: token, at least: candidates are rarely credentials, so they need odds of more than a thousand. A format that
#: is rarer than that among the candidates needs as much more.
ODDS = 7.0
#: Share of a format's own credentials that may score below its threshold.
MISS = 0.05


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, credential), ordered, code points, end exclusive.

    A rule takes the leftmost matches without overlap first and drops the short ones then. A
    run of hex digits or a key that is too short cannot hide a longer one, so there the
    length is part of the pattern."""
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    out.sort(key=lambda s: (s[0], s[1]))
    return out


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, token) of all runs that touch no base span."""
    starts, furthest = [], []
    for a, _, b, _ in base:
        starts.append(a)
        furthest.append(max(b, furthest[-1]) if furthest else b)
    out = []
    for m in _CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())
        if not before or furthest[before - 1] <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


def format_of(token: str) -> str:
    """What a token is made of: digits, letters of either case, signs. Formats have automata of their own."""
    kinds = set(classes(token))
    return "".join(name for name, some in (("d", "d"), ("l", "hl"), ("u", "Hu")) if kinds & set(some)) + ("+" if kinds - set("dhlHu") else "")


def either_case(s: str) -> str:
    """A class string with its upper-case letters as lower-case ones: keys are written in both."""
    return s.replace("H", "h").replace("u", "l")


#: How class strings are read: as they are, and without regard to case.
VIEWS = (str, either_case)


def learn(credentials: Mapping[tuple[int, str], list[str]], others: Mapping[str, int]) -> list[dict]:
    """For each view, automata of each kind and format with the threshold of its own credentials, and
    one of ordinary tokens.

    However few credentials there are, they get an automaton: with few, states merge and the
    threshold is what the least likely of them scores."""
    model = []
    for view in VIEWS:
        formats = {}
        for key, values in sorted(credentials.items()):
            if values:
                strings = Counter(view(classes(v)) for v in values)
                a = Automaton(strings)
                own = sorted(a.score_classes(s) for s in strings.elements())
                formats[key] = (a, own[int(MISS * len(own))], odds_of(sum(others.values()), len(own)))
        plain: Counter[str] = Counter()
        for s, n in others.items():
            plain[view(s)] += n
        # Some of the candidates are credentials themselves; what is clearly likelier as one is no ordinary token.
        first = Automaton(plain)
        kept = {s: n for s, n in plain.items() if not _fits(formats, first, s, 0.5)}
        model.append({"view": view, "formats": formats, "others": Automaton(kept)})
    return model


def odds_of(others: int, own: int) -> float:
    """The odds (their logarithm) that a format of so many credentials among so many candidates needs."""
    return max(ODDS, math.log(max(others, 1) / own))


def _fits(formats: dict, plain: Automaton, s: str, share: float = 1.0) -> bool:
    base, n = plain.likelihood(s), len(s) + 1
    return any((own := a.likelihood(s)) >= least * n and own - base > share * odds for a, least, odds in formats.values())


def judge(model: list[dict], s: str) -> bool:
    """Whether in some view an automaton finds the class string as likely as its own credentials, and so
    much likelier than the automaton of ordinary tokens does that it outweighs how rare credentials are.

    A token whose letters are all capitals is read without regard to case alone: any word may be written so,
    and ordinary tokens hold too few of them to tell."""
    capitals = either_case(s) != s and not {"l", "h"} & set(s)
    return any(_fits(m["formats"], m["others"], m["view"](s)) for m in model if not capitals or m["view"] is either_case)


def is_credential(model: list[dict], token: str) -> bool:
    return judge(model, classes(token))


def _line(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, LEARNT)
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))


def infer(strings: DataFrame, share: float = SHARE) -> dict[str, Automaton]:
    """An automaton for each model in ``strings`` (model, s, n: each class string once, with its count).

    All prefixes of all strings are counted. Those that at least ``share`` of a model's strings pass, and two at least,
    come to the driver as its prefix tree, with the exact counts of all their next symbols, and their states are merged there. Then
    every string goes through its automaton to the end, whatever left the tree, and these steps are its counts."""
    schema = "model string, node long, depth long, symbol string, n long"

    def steps_of(walk):
        def count(batches):
            for pdf in batches:
                found: Counter[tuple] = Counter()
                for model, s, n in zip(pdf["model"], pdf["s"], pdf["n"], strict=True):
                    walk(found, model, s, int(n))
                yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["model", "node", "depth", "symbol", "n"])

        return strings.mapInPandas(count, schema).groupBy("model", "node", "depth", "symbol").agg(F.sum("n").alias("n"))

    def in_tree(found, model, s, n):
        node = 0
        for depth, c in enumerate(s):
            found[model, node, depth, c] += n
            node = follow(node, c)
        found[model, node, len(s), END] += n

    least = strings.groupBy("model").agg(F.greatest(F.sum("n") * F.lit(share), F.lit(2.0)).alias("least"))
    nodes = steps_of(in_tree).groupBy("model", "node", "depth").agg(F.collect_list(F.struct("symbol", "n")).alias("steps"), F.sum("n").alias("passes"))
    kept = nodes.join(F.broadcast(least), "model").filter(F.col("passes") >= F.col("least") * F.greatest(F.lit(1.0), F.col("depth") / DEPTH))
    trees: dict[str, dict] = {r["model"]: {} for r in least.select("model").collect()}
    for r in kept.select("model", "node", "steps").collect():
        trees[r["model"]][r["node"]] = {x["symbol"]: x["n"] for x in r["steps"]}
    automata = {model: Automaton.of_tree(tree) for model, tree in trees.items()}
    to = {model: a.to for model, a in automata.items()}

    def in_automaton(found, model, s, n):
        at = 0
        for c in s:
            found[model, at, 0, c] += n
            at = to[model][at].get(c, at)
        found[model, at, 0, END] += n

    counts: dict[str, dict] = {model: {} for model in automata}
    for r in steps_of(in_automaton).collect():
        counts[r["model"]][r["node"], r["symbol"]] = r["n"]
    return {model: a.weigh(counts[model]) for model, a in automata.items()}


def fit(found: DataFrame) -> list[dict]:
    """What ``learn`` gives, from all distinct credentials and all candidates of a table of spans.

    The driver gets the automata, their prefix trees as ``infer`` bounds them, and how many credentials have each score, in
    steps of STEP; a threshold is the lower end of the step that it falls into."""
    name = F.concat_ws(":", F.col("kind"), F.col("format"))
    labelled = found.select(F.explode("base").alias("b")).select("b.kind", "b.format", "b.value", "b.classes").distinct()
    plain = found.select(F.explode("cand.classes").alias("classes"))
    both = labelled.select(name.alias("of"), "classes").unionByName(plain.select(F.lit("").alias("of"), "classes"))
    both = both.groupBy("of", "classes").agg(F.count("*").alias("n"))
    seen = [F.col("classes"), F.translate("classes", "Hu", "hl")]  # as VIEWS
    views = F.explode(F.array(*[F.struct(F.lit(f"{i}|").alias("view"), s.alias("s")) for i, s in enumerate(seen)]))
    both = both.select("of", views.alias("v"), "n").select(F.concat("v.view", "of").alias("model"), "v.s", "n")
    strings = stage(both.groupBy("model", "s").agg(F.sum("n").alias("n")), "class-strings")
    first = infer(strings)
    plain_names = [f"{i}|" for i in range(len(VIEWS))]
    candidates_in_all = sum(first[plain_names[0]].ends) if plain_names[0] in first else 0

    def scores(batches):
        for pdf in batches:
            step = [math.floor(first[m].score_classes(s) / STEP) for m, s in zip(pdf["model"], pdf["s"], strict=True)]
            yield pd.DataFrame({"model": pdf["model"], "step": step, "n": pdf["n"]})

    own = strings.filter(~F.col("model").isin(plain_names)).mapInPandas(scores, "model string, step long, n long")
    steps: dict[str, list] = {}
    for r in own.groupBy("model", "step").agg(F.sum("n").alias("n")).orderBy("step").collect():
        steps.setdefault(r["model"], []).append((r["step"], r["n"]))
    formats: list[dict] = [{} for _ in VIEWS]
    for model, counted in sorted(steps.items()):
        view, _, of = model.partition("|")
        kind, _, form = of.partition(":")
        total, at = sum(n for _, n in counted), 0
        for step, n in counted:
            at += n
            if at > int(MISS * total):
                formats[int(view)][int(kind), form] = (first[model], step * STEP, odds_of(candidates_in_all, total))
                break
    if not steps:
        return []
    ordinary = [first.get(m) for m in plain_names]

    def ordinary_only(batches):
        for pdf in batches:
            fits = [_fits(formats[i], ordinary[i], s, 0.5) for i, s in zip(pdf["model"].str[0].astype(int), pdf["s"], strict=True)]
            yield pdf[[not x for x in fits]]

    # Some of the candidates are credentials themselves; what is clearly likelier as one is no ordinary token.
    kept = strings.filter(F.col("model").isin(plain_names)).mapInPandas(ordinary_only, strings.schema)
    others = infer(stage(kept, "ordinary"))
    return [{"view": view, "formats": formats[i], "others": others.get(plain_names[i]) or Automaton({})} for i, view in enumerate(VIEWS)]


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base spans and candidates of each document, written to a table."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind_of_id = dict(rows.dtypes)["id"]

    def read(batches):
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("classes", pa.string())])
        labelled = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("format", pa.string()), ("classes", pa.string())])
        for batch in batches:
            base, cand = [], []
            for text in batch.column("text"):
                text = text.as_py()
                spans = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b, "value": v, "format": format_of(v), "classes": classes(v)} for a, k, b, v in spans])
                cand.append([{"start": a, "end": b, "classes": classes(v)} for a, b, v in candidates(text, spans)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(base, pa.list_(labelled)), pa.array(cand, pa.list_(span))],
                ["id", "base", "cand"],
            )

    schema = (
        f"id {kind_of_id}, base array<struct<kind:int,start:int,end:int,value:string,format:string,classes:string>>, "
        "cand array<struct<start:int,end:int,classes:string>>"
    )
    return stage(rows.mapInArrow(read, schema), "spans")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_assign, n_access, n_hex, n_learnt, base_sha256, spans.

    Null texts are empty: no spans, and the digest of the empty line. Null ids and rows that repeat
    an id or a text are rows of their own; texts of any length are read whole, once: spans and the
    class strings of all candidates go to a table. The automata and their thresholds come from all distinct credentials
    of each kind and format and from all candidates of all texts. Then every candidate is scored. Without credentials there is nothing to
    learn from and no span is added.
    """
    found = spans_of(docs, id_col, text_col)
    model = fit(found)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_learnt long, base_sha256 string, spans string")
    def finish(base: pd.Series, cand: pd.Series) -> pd.DataFrame:
        out = []
        known: dict[str, bool] = {}

        def fits(s: str) -> bool:
            if s not in known:
                known[s] = judge(model, s)
            return known[s]

        for b, c in zip(base, cand, strict=True):
            fixed = [(int(x["start"]), int(x["kind"]), int(x["end"])) for x in b]
            more = [(int(x["start"]), len(KINDS), int(x["end"])) for x in c if fits(x["classes"])]
            n = [sum(k == i for _, k, _ in fixed) for i in range(len(KINDS))]
            out.append((*n, len(more), hashlib.sha256(_line(fixed).encode()).hexdigest(), _line(fixed + more)))
        return pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "n_learnt", "base_sha256", "spans"])

    return found.select(F.col("id").alias(id_col), finish("base", "cand").alias("s")).select(id_col, "s.*")
