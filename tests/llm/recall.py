"""Prints the recall of op10 on a folder of tables against brute force: python -m tests.llm.recall [folder]."""

import collections
import sys

import numpy as np

from corpusmill.llm import neighbours
from corpusmill.session import local_session


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session("8", 8, "8g")
    rows = neighbours.usable(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding").orderBy("id").collect()
    ids, v = np.array([r.id for r in rows]), np.array([r.v for r in rows])
    found = collections.defaultdict(set)
    for r in neighbours.op10(spark, folder).collect():
        found[r.query_id].add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = v @ v[q]
        score[q] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        hits, total = hits + len(found[int(ids[q])] & set(ids[best].tolist())), total + len(best)
    print(f"recall {hits / total:.4f} over {total} neighbours of {len(found)} queries")
    spark.stop()


if __name__ == "__main__":
    main()
