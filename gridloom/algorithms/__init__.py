"""Iterative analytics on distributed objects."""

from gridloom.algorithms.forest import random_forest
from gridloom.algorithms.glm import glm, glm_control
from gridloom.algorithms.kmeans import kmeans
from gridloom.algorithms.pagerank import pagerank

__all__ = ["glm", "glm_control", "kmeans", "pagerank", "random_forest"]
