"""A graph encoder with user-supplied weights, as a plug-in beside the structural embedding.

Linear, convolutions whose input joins all earlier layers through sigmoid gates, sum pooling, and a
two-layer head. The convolutions are sums over neighbours; loops are taken out first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.registry import ENCODERS, Registry

CONVOLUTIONS = Registry("convolution")
Weights = dict[str, np.ndarray]


def linear(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]


def gather(x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``x`` at the sources of each node's edges."""
    out = np.zeros_like(x)
    keep = src != dst
    np.add.at(out, dst[keep], x[src[keep]])
    return out


@CONVOLUTIONS.register("SAGE")
def sage(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return linear(np.concatenate([gather(linear(x, w, f"{name}.lin"), src, dst), x], 1), w, f"{name}.update")


@CONVOLUTIONS.register("GIN")
def gin(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights, name: str) -> np.ndarray:
    eps = float(w.get(f"{name}.eps", np.zeros(1))[0])
    return linear(np.maximum(linear((1 + eps) * x + gather(x, src, dst), w, f"{name}.nn0"), 0), w, f"{name}.nn1")


@CONVOLUTIONS.register("GCN")
def gcn(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights, name: str) -> np.ndarray:
    keep = src != dst
    s, d = np.append(src[keep], np.arange(len(x))), np.append(dst[keep], np.arange(len(x)))
    deg = np.bincount(d, minlength=len(x)).astype(float)
    h, out = linear(x, w, f"{name}.lin"), np.zeros((len(x), w[f"{name}.lin.weight"].shape[0]))
    np.add.at(out, d, h[s] / np.sqrt(deg[s] * deg[d])[:, None])
    return out


@CONVOLUTIONS.register("graph")
def graph_conv(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return linear(gather(x, src, dst), w, f"{name}.lin") + linear(x, w, f"{name}.root")


@CONVOLUTIONS.register("GAT")
def gat(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """One attention head; a node attends to itself too."""
    keep = src != dst
    s, d = np.append(src[keep], np.arange(len(x))), np.append(dst[keep], np.arange(len(x)))
    h = x @ w[f"{name}.lin.weight"].T
    raw = (h @ w[f"{name}.att_src"])[s] + (h @ w[f"{name}.att_dst"])[d]
    raw = np.where(raw > 0, raw, 0.2 * raw)
    top = np.full(len(x), -np.inf)
    np.maximum.at(top, d, raw)
    share, out = np.exp(raw - top[d]), np.zeros_like(h)
    share /= np.bincount(d, share, len(x))[d]
    np.add.at(out, d, share[:, None] * h[s])
    return out + w[f"{name}.lin.bias"]


@CONVOLUTIONS.register("gated")
def gated(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """One step of a gated recurrent unit, whose state is ``x`` and whose input is the neighbours' sum."""
    weight = w[f"{name}.weight"]
    if x.shape[1] > len(weight):
        raise ValueError(f"gated convolutions take {len(weight)} features at most, not {x.shape[1]}: use skip='none'")
    x = np.pad(x, ((0, 0), (0, len(weight) - x.shape[1])))
    a = linear(gather(x @ weight, src, dst), w, f"{name}.ih")
    b = linear(x, w, f"{name}.hh")
    (ar, az, an), (br, bz, bn) = np.split(a, 3, 1), np.split(b, 3, 1)
    reset, update = 1 / (1 + np.exp(-ar - br)), 1 / (1 + np.exp(-az - bz))
    return (1 - update) * np.tanh(an + reset * bn) + update * x


@CONVOLUTIONS.register("PNA")
def pna(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """Three SAGE convolutions side by side; all three sum, whatever their names."""
    return np.concatenate([sage(x, src, dst, w, f"{name}.{part}") for part in ("sum", "mean", "max")], 1)


def forward(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights, n_layers: int, conv: str = "SAGE", skip: str | None = None) -> np.ndarray:
    """Embedding of one graph. ``skip``: ``learnable`` (with gates), ``all`` or ``none`` earlier layers go into each; the weights decide if it isn't given."""
    skip = skip or ("learnable" if "skip" in w else "all")
    if skip not in ("learnable", "all", "none"):
        raise ValueError(f"unknown skip {skip!r}; there are learnable, all, none")
    h = linear(x, w, "pre")
    layers = h
    gates = w["skip"] if skip == "learnable" else None
    emb = [h]
    for k in range(n_layers):
        if gates is not None:
            gate = 1 / (1 + np.exp(-gates[k, : k + 1]))
            inp = np.concatenate([g * e for g, e in zip(gate, emb, strict=False)], 1)
        else:
            inp = layers if skip == "all" else h
        h = np.maximum(CONVOLUTIONS[conv](inp, src, dst, w, f"conv{k}"), 0)
        emb.append(h)
        layers = np.concatenate([layers, h], 1)
    pooled = layers.sum(0, keepdims=True)
    return linear(np.maximum(linear(pooled, w, "post0"), 0), w, "post1")[0]


def random_weights(input_dim: int = 2, hidden: int = 16, output: int = 16, n_layers: int = 3, conv: str = "SAGE", seed: int = 0) -> Weights:
    """Untrained weights of the right shapes; those of ``gated`` are for ``skip="none"``."""
    rng = np.random.default_rng(seed)
    w: Weights = {} if conv == "gated" else {"skip": np.zeros((n_layers, n_layers))}
    width = 3 * hidden if conv == "PNA" else hidden

    def put(name: str, a: int, b: int) -> None:
        w[f"{name}.weight"], w[f"{name}.bias"] = rng.normal(size=(b, a)) / np.sqrt(a), np.zeros(b)

    put("pre", input_dim, width)
    for k in range(n_layers):
        d = width * (k + 1)
        if conv == "SAGE":
            put(f"conv{k}.lin", d, d)
            put(f"conv{k}.update", 2 * d, hidden)
        elif conv == "GIN":
            put(f"conv{k}.nn0", d, hidden)
            put(f"conv{k}.nn1", hidden, hidden)
        elif conv == "PNA":
            for part in ("sum", "mean", "max"):
                put(f"conv{k}.{part}.lin", d, d)
                put(f"conv{k}.{part}.update", 2 * d, hidden)
        elif conv == "GAT":
            put(f"conv{k}.lin", d, hidden)
            w[f"conv{k}.att_src"], w[f"conv{k}.att_dst"] = rng.normal(size=(2, hidden)) / np.sqrt(hidden)
        elif conv == "gated":
            w[f"conv{k}.weight"] = rng.normal(size=(hidden, hidden)) / np.sqrt(hidden)
            put(f"conv{k}.ih", hidden, 3 * hidden)
            put(f"conv{k}.hh", hidden, 3 * hidden)
        else:
            put(f"conv{k}.lin", d, hidden)
            put(f"conv{k}.root", d, hidden)
    put("post0", width * (n_layers + 1), hidden)
    put("post1", hidden, output)
    return w


@ENCODERS.register("skip_last_gnn")
def encode(graphs: DataFrame, weights: Weights, n_layers: int = 3, conv: str = "SAGE", input_dim: int = 2, skip: str | None = None) -> DataFrame:
    """``nb, emb`` of neighbourhoods, one row each: ``nb``, ``x`` (array of feature arrays in local order), ``src`` and ``dst`` (local ids)."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series, src: pd.Series, dst: pd.Series) -> pd.Series:
        out = []
        for a, s, d in zip(x, src, dst, strict=True):
            feats = np.stack([np.asarray(v, float)[:input_dim] for v in a])
            out.append(forward(feats, np.asarray(s, np.int64), np.asarray(d, np.int64), weights, n_layers, conv, skip).astype(np.float32))
        return pd.Series(out)

    return graphs.select("nb", run("x", "src", "dst").alias("emb"))


def as_rows(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``nb, x, src, dst`` of neighbourhoods (``nb, anchor, node``), for `encode`; a row is one neighbourhood of bounded size."""
    from filigree.operators import graph

    labels = graph.relabel(members)
    inner = graph.relabelled_edges(graph.induced(edges, members), labels)
    x = labels.groupBy("nb").agg(F.transform(F.array_sort(F.collect_list("local")), lambda i: F.array(F.when(i == 0, 1.0).otherwise(0.0), F.lit(1.0))).alias("x"))
    e = inner.groupBy("nb").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e"))
    none = F.array().cast("array<struct<src:long,dst:long>>")
    both = x.join(e, "nb", "left").withColumn("e", F.coalesce("e", none))
    return both.select("nb", "x", F.transform("e", lambda p: p["src"]).alias("src"), F.transform("e", lambda p: p["dst"]).alias("dst"))
