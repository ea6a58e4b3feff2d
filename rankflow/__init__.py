"""rankflow: keyed-record algebra and learning-to-rank on Spark DataFrames."""

from rankflow.relation import Relation

__all__ = ["Relation"]
