"""Model files: a node table, INI networks of decision trees, XML ensembles. Written and read on the driver."""

from __future__ import annotations

import configparser
import io
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

from rankflow.ltr.boost import Ensemble, Node, Tree

SCHEMA = "iter int, k int, node int, feature string, threshold double, left int, right int, value double, gain double"
#: The iteration of the row that holds the base score.
BASE = -1
#: Fixed value: leaf values in XML files are multiplied by this.
XML_SCALE = 1_000_000


def to_table(model: Ensemble, spark: SparkSession) -> DataFrame:
    rows = [(i, k, j, n.feature, n.threshold, n.left, n.right, float(n.value), float(n.gain)) for i, trees in enumerate(model.trees) for k, t in enumerate(trees) for j, n in enumerate(t.nodes)]
    rows.append((BASE, 0, 0, None, 0.0, -1, -1, float(model.base), 0.0))
    return spark.createDataFrame(rows, SCHEMA)


def from_table(df: DataFrame) -> Ensemble:
    model = Ensemble()
    for r in sorted(df.collect(), key=lambda r: (r.iter, r.k, r.node)):  # a model's nodes
        if r.iter == BASE:
            model.base = r.value
            continue
        while len(model.trees) <= r.iter:
            model.trees.append([])
        while len(model.trees[r.iter]) <= r.k:
            model.trees[r.iter].append(Tree([]))
        model.trees[r.iter][r.k].nodes.append(Node(r.feature, r.threshold, r.left, r.right, r.value, r.gain))
    model.features = sorted({n.feature for trees in model.trees for t in trees for n in t.nodes if n.feature})
    return model


def to_ini(model: Ensemble) -> str:
    """A network whose inputs are trees. Its first layer has a node for each class that adds up the class's trees; with
    several classes, a second layer's one node is the mean of the classes' numbers, weighted by the softmax of the first.
    """
    out = configparser.ConfigParser(delimiters=("=",), interpolation=None)
    out.optionxform = str
    trees = [(k, t) for ts in model.trees for k, t in enumerate(ts)]
    classes = max([1, *map(len, model.trees)])
    out["NeuralNet"] = {"Layers": "2" if classes > 1 else "1", "Inputs": str(len(trees))}
    for i, (_, t) in enumerate(trees):
        own = {"Transform": "DecisionTree", "Nodes": str(len(t.nodes))}
        for j, n in enumerate(t.nodes):
            own[f"Node{j}"] = f"leaf\t{n.value!r}" if n.feature is None else f"split\t{n.feature}\t{n.threshold!r}\t{n.left}\t{n.right}"
        out[f"Input:{i + 1}"] = own
    out["Layer:1"] = {"Nodes": str(classes)}
    for c in range(classes):
        out[f"Node:1:{c + 1}"] = {"Type": "Linear", "Bias": repr(model.base)} | {f"Weight:{i + 1}": "1" for i, (k, _) in enumerate(trees) if k == c}
    if classes > 1:
        out["Layer:2"] = {"Nodes": "1"}
        out["Node:2:1"] = {"Type": "SoftmaxMean", "Bias": "0"} | {f"Weight:{c + 1}": str(c) for c in range(classes)}
    text = io.StringIO()
    out.write(text)
    return text.getvalue()


def from_ini(text: str) -> Ensemble:
    read = configparser.ConfigParser(delimiters=("=",), interpolation=None)
    read.optionxform = str
    read.read_string(text)
    model = Ensemble(base=float(read["Node:1:1"]["Bias"]))
    by_class: list[list[Tree]] = []
    for c in range(int(read["Layer:1"]["Nodes"])):
        mine = []
        for i in sorted(int(key.removeprefix("Weight:")) for key in read[f"Node:1:{c + 1}"] if key.startswith("Weight:")):
            own, nodes = read[f"Input:{i}"], []
            for j in range(int(own["Nodes"])):
                kind, *rest = own[f"Node{j}"].split("\t")
                nodes.append(Node(value=float(rest[0])) if kind == "leaf" else Node(rest[0], float(rest[1]), int(rest[2]), int(rest[3])))
            mine.append(Tree(nodes))
        by_class.append(mine)
    model.trees = [list(ts) for ts in zip(*by_class, strict=True)]
    model.features = sorted({n.feature for ts in model.trees for t in ts for n in t.nodes if n.feature})
    return model


def to_xml(model: Ensemble) -> str:
    root = ET.Element("gbm", base=repr(model.base))
    for i, trees in enumerate(model.trees):
        for k, t in enumerate(trees):
            lines = ["\t".join((str(j), "", "", "", "", str(round(n.value * XML_SCALE))) if n.feature is None else (str(j), n.feature, repr(n.threshold), str(n.left), str(n.right), "")) for j, n in enumerate(t.nodes)]
            ET.SubElement(root, "tree", iteration=str(i), k=str(k)).text = "\n".join(lines)
    return ET.tostring(root, encoding="unicode")
