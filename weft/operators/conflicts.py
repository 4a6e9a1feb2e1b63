"""Mappings between many ontologies made coherent by votes.

mappings: src_onto, src_id, tgt_onto, tgt_id, similarity, with src_onto < tgt_onto and each
pair of ontologies mapped one to one. If a goes with b and b with c, then a should go with c:
each triple of ontologies votes for the mappings that agree and against those that don't.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.cut import kept as _checked
from weft.operators.selection import labelled_blocks

ENDS = ["src_onto", "src_id", "tgt_onto", "tgt_id"]


class Net:
    """The mappings of one connected block, by either end and the other end's ontology."""

    def __init__(self, rows: list[tuple[int, int, int, int, float]]):
        self.at: dict[tuple[int, int, int], tuple[int, int, int, int]] = {}
        self.vote: dict[tuple[int, int, int, int], int] = {}
        self.similarity: dict[tuple[int, int, int, int], float] = {}
        self.valid: set[tuple[int, int, int, int]] = set()
        for i, a, j, b, similarity in rows:
            self.put(i, a, j, b, similarity)
        self.ontologies = sorted({m[0] for m in self.vote} | {m[2] for m in self.vote})
        for m in sorted(self.vote):
            for k in (k for k in self.ontologies if k > m[2]):
                p, q = self.at.get((m[0], m[1], k)), self.at.get((m[2], m[3], k))
                if p or q:
                    change = 1 if p and q and p[3] == q[3] else -1
                    for each in (m, p, q):
                        if each:
                            self.vote[each] += change

    def drop(self, mapping: tuple[int, int, int, int] | None) -> None:
        if mapping:
            i, a, j, b = mapping
            del self.at[i, a, j], self.at[j, b, i], self.vote[mapping], self.similarity[mapping]
            self.valid.discard(mapping)

    def put(self, i: int, a: int, j: int, b: int, similarity: float) -> tuple[int, int, int, int]:
        """Map a to b; what either was mapped to in the other's ontology goes."""
        if i > j:
            i, a, j, b = j, b, i, a
        self.drop(self.at.get((i, a, j)))
        self.drop(self.at.get((j, b, i)))
        made = i, a, j, b
        self.at[i, a, j] = self.at[j, b, i] = made
        self.vote[made], self.similarity[made] = 0, similarity
        return made

    def partner(self, onto: int, node: int, other: int) -> int | None:
        found = self.at.get((onto, node, other))
        return None if found is None else found[3] if found[0] == onto else found[1]

    def settle(self, mapping: tuple[int, int, int, int]) -> None:
        """Take a mapping as right and make all others follow from it."""
        self.valid.add(mapping)
        left = [mapping]
        while left:
            now = left.pop()
            if now not in self.vote:
                continue
            i, a, j, b = now
            strength = self.similarity[now]
            for k in self.ontologies:
                if k in (i, j):
                    continue
                c, d = self.partner(i, a, k), self.partner(j, b, k)
                if c is None and d is None:
                    continue
                p, q = self.at.get((i, a, k)), self.at.get((j, b, k))
                if c != d:
                    if c is not None and d is not None and p in self.valid and q in self.valid:
                        continue  # both were settled before: they stay
                    if d is None or (c is not None and (p in self.valid or (q not in self.valid and (self.vote[p], self.similarity[p]) > (self.vote[q], self.similarity[q])))):
                        self.put(j, b, k, c, strength)
                    else:
                        self.put(i, a, k, d, strength)
                for end in ((i, a, k), (j, b, k)):
                    found = self.at.get(end)
                    if found and found not in self.valid:
                        self.valid.add(found)
                        left.append(found)

    def resolve(self) -> list[tuple[int, int, int, int, float]]:
        """All mappings once each is settled: the best vote first, then the greatest similarity, then the least ends."""
        order = [(-self.vote[m], -self.similarity[m], m) for m in self.vote]
        heapq.heapify(order)
        while order:
            vote, _, m = heapq.heappop(order)
            if m in self.vote and m not in self.valid and self.vote[m] == -vote:
                self.settle(m)
        return sorted((*m, self.similarity[m]) for m in self.vote)


def resolved(mappings: DataFrame) -> DataFrame:
    """The mappings after all conflicts are resolved; blocks that no mapping joins are resolved apart.

    A block holds the nodes that mappings reach from one another, which are few where ontologies
    are mapped one to one; each is one group.
    """
    node = lambda side: F.concat_ws(":", f"{side}_onto", f"{side}_id")
    rows = _checked(mappings.select(*ENDS, "similarity", node("src").alias("a"), node("tgt").alias("b")))
    links = rows.select(F.explode(F.array(*(F.struct(F.col(x).alias("src_id"), F.col(y).alias("tgt_id")) for x in "ab" for y in "ab"))).alias("l")).select("l.*").distinct()
    blocks = labelled_blocks(_checked(links)).select(F.col("src_id").alias("a"), "block").distinct()
    kinds = dict(mappings.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(r[0]), int(r[1]), int(r[2]), int(r[3]), float(r[4])) for r in group.sort_values(ENDS)[[*ENDS, "similarity"]].itertuples(index=False)]
        return pd.DataFrame(Net(rows).resolve(), columns=[*ENDS, "similarity"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in ENDS) + ", similarity double"
    return rows.join(blocks, "a").select("block", *ENDS, "similarity").groupBy("block").applyInPandas(run, schema)
