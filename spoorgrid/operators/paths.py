"""Best candidate paths along sequences of any length, as an associative max-plus scan.

A chunk of a sequence is a matrix: the best score of a path from each candidate of the frame before the chunk to each candidate
of its last frame. Matrices are made by all chunks at once. One row per chunk is then enough to tell the scores at every border
and, going back from the best last candidate, the candidate of the path there. Each chunk repeats its own frames from the known
scores and goes back from the known candidate, independently of the others. The number of rounds doesn't depend on the length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorgrid.operators.chunks import chunk_of
from spoorgrid.session import cut

PATH_OUT = "sequence int, frame_idx int, selected_idx int, patch_id int, path_score double"


def steps_between(a: list, b: list, sigma: float, yaw_sigma: float, stay: float) -> np.ndarray:
    """Scores of the steps from each candidate of a frame to each one of the next."""
    ax, ay, aw, ap = (np.array([c[k] for c in a], float)[:, None] for k in ("x", "y", "yaw", "patch_id"))
    bx, by, bw, bp = (np.array([c[k] for c in b], float)[None] for k in ("x", "y", "yaw", "patch_id"))
    turn = np.degrees(np.abs((bw - aw + np.pi) % (2 * np.pi) - np.pi))
    far = -0.5 * ((bx - ax) ** 2 + (by - ay) ** 2) / max(sigma, 1.0e-6) ** 2
    return far - 0.5 * (turn / max(yaw_sigma, 1.0e-6)) ** 2 + np.where(ap == bp, stay, 0.0)


def smooth_sequence(frames: DataFrame, sigma: float = 2.0, yaw_sigma: float = 30.0, stay: float = 0.3, chunk: int = 100_000) -> DataFrame:
    """The path of greatest score through the candidates of each sequence (sequence, frame_idx, candidate_results).

    A path scores its candidates' final_score and, for two frames in a row, nearness in place and heading and a bonus for staying on a patch.
    path_score is the score up to a frame; the first of equal candidates wins. Frames without candidates have no row and are passed over.
    """
    rows = frames.where(F.size("candidate_results") > 0)
    small = F.transform("candidate_results", lambda c: F.struct(*[c[k].alias(k) for k in ("x", "y", "yaw", "patch_id", "final_score")]))
    rows = cut(rows.select("sequence", "frame_idx", small.alias("c"), chunk_of("frame_idx", chunk).alias("_chunk")))
    line = Window.partitionBy("sequence").orderBy("_chunk")  # one row per chunk
    ends = rows.groupBy("sequence", "_chunk").agg(F.max_by("c", "frame_idx").alias("_tail"))
    ends = ends.select("sequence", "_chunk", F.lag("_tail").over(line).alias("_before"))
    rows = rows.join(ends, ["sequence", "_chunk"])

    def walk(pdf: pd.DataFrame, scores: np.ndarray):
        """Scores of all frames (one row for each row of entry scores) and the best candidate before each one."""
        before = pdf["_before"].iloc[0]
        for c in pdf["c"]:
            own = np.array([x["final_score"] for x in c], float)
            if before is None:
                scores, back = np.repeat(own[None], len(scores), 0), np.full((len(scores), len(c)), -1)
            else:
                ways = scores[:, :, None] + steps_between(before, c, sigma, yaw_sigma, stay)[None]
                back = ways.argmax(1)
                scores = ways.max(1) + own
            before = c
            yield scores, back

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        before = pdf["_before"].iloc[0]
        entry = np.zeros((1, 1))
        if before is not None:
            entry = np.where(np.eye(len(before), dtype=bool), 0.0, -np.inf)
        for scores, _ in walk(pdf, entry):  # noqa: B007
            pass
        return pd.DataFrame({"sequence": pdf["sequence"].iloc[:1], "_chunk": pdf["_chunk"].iloc[:1], "matrix": [scores.tolist()]})

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        entry, entries, ways = np.zeros(1), [], []
        for matrix in pdf["matrix"]:
            through = entry[:, None] + np.array([list(r) for r in matrix])
            entries.append(entry.tolist())
            ways.append(through.argmax(0))
            entry = through.max(0)
        leave, leaves = int(entry.argmax()), []
        for way in reversed(ways):
            leaves.append(leave)
            leave = int(way[leave])
        return pd.DataFrame({"sequence": pdf["sequence"], "_chunk": pdf["_chunk"], "entry": entries, "leave": leaves[::-1]})

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        steps = list(walk(pdf, np.array([list(pdf["entry"].iloc[0])])))
        at, picks = int(pdf["leave"].iloc[0]), []
        for scores, back in reversed(steps):
            picks.append((at, float(scores[0, at])))
            at = int(back[0, at])
        picks = picks[::-1]
        return pd.DataFrame({"sequence": pdf["sequence"], "frame_idx": pdf["frame_idx"], "selected_idx": [i for i, _ in picks],
                             "patch_id": [int(c[i]["patch_id"]) for c, (i, _) in zip(pdf["c"], picks)], "path_score": [s for _, s in picks]})

    matrices = rows.groupBy("sequence", "_chunk").applyInPandas(measure, "sequence int, _chunk long, matrix array<array<double>>")
    known = matrices.groupBy("sequence").applyInPandas(borders, "sequence int, _chunk long, entry array<double>, leave int")
    return rows.join(known, ["sequence", "_chunk"]).groupBy("sequence", "_chunk").applyInPandas(trace, PATH_OUT)
