"""The iterative search against a plain-Python model of the same rules.

Tokens are taken from Spark (the tokenizer has its own oracle test); the
model re-implements the rest one question at a time: BM25 candidates,
all-abstracts-empty re-ask, per-question index, cosine hits, FLOAT threshold,
bag append, keyword feedback, round bound and the final ranking.
"""

import math
from collections import defaultdict

import numpy as np
import pytest
import regex

from litsearch.catalog import queries as Q
from litsearch.functions.text import tokens
from litsearch.operators.lexical import BM25_B, BM25_K1, searchable_text
from litsearch.plans.search import SearchConfig, search
from litsearch.sources import fixtures as FX
from litsearch.sources.requests import apply_defaults
from tests.conftest import SF_SMALL


def searchable(papers):
    return papers.select("pmc_id", tokens(searchable_text()).alias("lex"),
                         tokens("abstract").alias("abs"), "abstract", "keywords")


def render(groups):
    by = defaultdict(list)
    for g, t in groups:
        by[g].append(t)
    return " and ".join("(" + " or ".join(f'"{t}"' for t in sorted(by[g])) + ")"
                        for g in sorted(by))


class Model:
    def __init__(self, papers, queries, alts, max_tokens=3500, hits=20, top_kw=3, rounds=12):
        self.p = papers
        self.n = len(papers)
        self.avg = sum(len(v["lex"]) for v in papers.values()) / self.n
        self.post = defaultdict(dict)
        for pid, v in papers.items():
            for t in v["lex"]:
                self.post[t][pid] = self.post[t].get(pid, 0) + 1
        self.q, self.alts = queries, alts
        self.max_tokens, self.hits, self.top_kw, self.rounds = max_tokens, hits, top_kw, rounds

    def match(self, groups, limit):
        n_groups = len({g for g, _ in groups})
        primary = {}
        for g, t in groups:
            primary[t] = min(g, primary.get(t, g))
        score, matched = defaultdict(float), defaultdict(set)
        for g, t in sorted(set(groups)):
            plist = self.post.get(t, {})
            df = len(plist)
            for pid, tf in plist.items():
                matched[pid].add(g)
                if g == primary[t]:
                    idf = math.log(1.0 + ((self.n - df) + 0.5) / (df + 0.5))
                    dl = len(self.p[pid]["lex"])
                    score[pid] += (idf * (tf * (BM25_K1 + 1.0))) / (
                        tf + BM25_K1 * ((1.0 - BM25_B) + (BM25_B * dl) / self.avg))
        found = [(-round(score[p], 6), p) for p in matched if len(matched[p]) == n_groups]
        return [p for _, p in sorted(found)[:limit]]

    def run(self, qid):
        q = self.q[qid]
        qcount = defaultdict(int)
        for t in q["toks"]:
            qcount[t] += 1
        qq = sum(c * c for c in qcount.values())
        amount, thr = q["amount"], np.float32(q["threshold"])
        groups, text, kind, next_alt = self.alts[qid][0], render(self.alts[qid][0]), "initial", 1
        rows, index, attempts = [], {}, []
        for r in range(self.rounds):
            attempts.append((qid, r, text, kind))
            cands = self.match(groups, 2 * amount)
            if all(self.p[c]["abstract"] == "" for c in cands):
                if next_alt in self.alts[qid]:
                    groups = self.alts[qid][next_alt]
                    text, kind, next_alt = render(groups), "requery", next_alt + 1
                    continue
                break
            for c in cands:
                a = self.p[c]
                if a["abstract"] != "" and len(a["abs"]) <= self.max_tokens:
                    qa = sum(qcount.get(t, 0) for t in a["abs"])
                    ac = defaultdict(int)
                    for t in a["abs"]:
                        ac[t] += 1
                    aa = sum(x * x for x in ac.values())
                    index[c] = (qa + qq) / (math.sqrt(qq) * math.sqrt(aa + 2.0 * qa + qq))
            ranked = sorted(index.items(), key=lambda kv: (-kv[1], kv[0]))[: self.hits]
            hits = {pid: (i + 1, np.float32(s)) for i, (pid, s) in enumerate(ranked)}
            scored = [(c, hits[c][1] if c in hits else np.float32(0.0)) for c in cands]
            passing = sorted((hits[c][0], c) for c in cands if c in hits and hits[c][1] > thr)
            rows += [(r, hr, c, hits[c][1]) for hr, c in passing]
            if amount <= len(rows):
                break
            src = [(c, s) for _, _, c, s in rows] if rows else scored
            w = defaultdict(float)
            for c, s in src:
                for k in self.p[c]["keywords"]:
                    w[k] += float(s)
            top = [k for k, _ in sorted(w.items(), key=lambda kv: (-kv[1], kv[0]))[: self.top_kw]]
            if not top:
                break
            text, kind = " ".join(top), "feedback"
            toks = [t for t in self.q_tokens(text)]
            groups = [(toks.index(t), t) for t in dict.fromkeys(toks)]
        n = len(rows)
        if amount > n:
            final = rows
        else:
            final = sorted(rows, key=lambda x: (-float(x[3]), x[0], x[1], x[2]))[:amount]
        ranked = [(qid, i + 1, c, float(s), min(amount, n)) for i, (_, _, c, s) in enumerate(final)]
        return ranked, attempts

    def q_tokens(self, text):
        return self.tok_fn(text)


@pytest.fixture(scope="module")
def inputs(spark):
    d = FX.load(spark, SF_SMALL)
    papers = {r.pmc_id: r.asDict() for r in searchable(d["papers"]).collect()}
    params = apply_defaults(d["queries"])
    qrows = params.select("query_id", tokens("user_query").alias("toks"), "amount",
                          "threshold").collect()
    queries = {r.query_id: r.asDict() for r in qrows}
    alts = defaultdict(dict)
    for r in d["query_terms"].collect():
        alts[r.query_id].setdefault(r.alt, []).append((r.group_id, r.term))
    return d, papers, queries, alts


def test_loop_matches_model(spark, inputs):
    d, papers, queries, alts = inputs
    out = search(d["queries"], d["query_terms"], d["papers"], config=SearchConfig())
    model = Model(papers, queries, alts)
    # feedback strings are keywords (already lower-case tokens) joined by spaces
    model.tok_fn = lambda text: regex.findall(r"[\p{L}\p{N}]+", text.lower())
    exp_ranked, exp_attempts = [], []
    for qid in sorted(queries):
        r, a = model.run(qid)
        exp_ranked += r
        exp_attempts += a
    got_ranked = sorted((r.query_id, r.rk, r.pmc_id, float(r.search_score), r.paper_count)
                        for r in out.ranked.collect())
    got_attempts = sorted(tuple(r) for r in out.attempts.select(
        "query_id", "round", "query_text", "kind").collect())
    assert got_attempts == sorted(exp_attempts)
    assert got_ranked == sorted(exp_ranked)
    assert max(r[1] for r in got_attempts) <= 11           # at most 12 rounds
    for qid, _, _, score, count in got_ranked:              # every kept score beats its threshold
        assert np.float32(score) > np.float32(queries[qid]["threshold"])
        assert count <= queries[qid]["amount"]


def test_fixed_points_are_written_without_being_run(spark):
    """A question that repeats its string and finds nothing new is in the log up to the bound, but not in the rounds run."""
    from litsearch.plans.search import with_repeats
    records = spark.createDataFrame([("a", 0, False, "x"), ("a", 1, True, "x"), ("b", 0, False, "y")],
                                    "query_id string, round int, fixed boolean, _query_text string")
    got = sorted((r.query_id, r["round"]) for r in with_repeats(records, 5).collect())
    assert got == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 0)]
    out = Q.run_search(spark, SF_SMALL)
    bound = out.ends.where("status = 'bound'").count()
    logged = {r["round"]: r["count"] for r in out.attempts.groupBy("round").count().collect()}
    assert all(logged[r] >= n for r, n in enumerate(out.active_per_round))
    if bound:
        assert logged[11] == bound and (len(out.active_per_round) < 12 or out.active_per_round[11] <= bound)
