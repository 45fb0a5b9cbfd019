"""Graph steps over vertices ``(type, id, ...)`` and edges ``(label, head_type, head_id, tail_type, tail_id, ...)``.

OUT follows an edge from its head to its tail, IN the other way. Results are bags: a vertex that is reached twice
is there twice. Edges may name vertices that don't exist; steps to them end.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.criteria import wide

ENDS = {"OUT": ("head", "tail"), "IN": ("tail", "head")}


def adjacent_edges(vertices: DataFrame, edges: DataFrame, direction: str, labels: Iterable[str] | None = None, query=None) -> DataFrame:
    """Edges that leave the vertices in the direction, one for each vertex and edge that meet."""
    near, _ = ENDS[direction]
    own = edges if labels is None else edges.where(F.col("label").isin(*sorted(labels)))
    own = own if query is None else own.where(wide(query))
    at = vertices.select(F.col("type").alias(f"{near}_type"), F.col("id").alias(f"{near}_id"))
    return own.join(at, [f"{near}_type", f"{near}_id"])


def adjacencies(vertices: DataFrame, edges: DataFrame, all_vertices: DataFrame, direction: str, labels: Iterable[str] | None = None, query=None) -> DataFrame:
    """Vertices at the other ends of these edges."""
    _, far = ENDS[direction]
    met = adjacent_edges(vertices, edges, direction, labels, query).select(F.col(f"{far}_type").alias("type"), F.col(f"{far}_id").alias("id"))
    return all_vertices.join(met, ["type", "id"])


def k_hops(vertices: DataFrame, edges: DataFrame, all_vertices: DataFrame, direction: str, hops: int, labels: Iterable[str] | None = None) -> DataFrame:
    """Vertices after so many steps."""
    for _ in range(hops):
        vertices = adjacencies(vertices, edges, all_vertices, direction, labels)
    return vertices


class Traversal:
    """Steps one after another with the path walked: ``Traversal(g_v, g_e).start(v).out("has").has(node).frame()``.

    ``vertex_types`` and ``labels`` restrict the graph that is walked.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, vertex_types: Iterable[str] | None = None, labels: Iterable[str] | None = None):
        self.vertices = vertices if vertex_types is None else vertices.where(F.col("type").isin(*sorted(vertex_types)))
        self.edges = edges if labels is None else edges.where(F.col("label").isin(*sorted(labels)))
        self._at: DataFrame | None = None

    def _with(self, at: DataFrame) -> Traversal:
        new = Traversal(self.vertices, self.edges)
        new._at = at
        return new

    def start(self, where) -> Traversal:
        """Begin at the vertices that a condition (column or criteria tree) holds for."""
        own = self.vertices.where(where if not hasattr(where, "__dataclass_fields__") else wide(where))
        return self._with(own.withColumn("path", F.array(F.struct("type", "id"))))

    def _step(self, direction: str, labels: tuple[str, ...], edges=None) -> Traversal:
        near, far = ENDS[direction]
        own = self.edges.where(F.col("label").isin(*labels)) if labels else self.edges
        if edges is not None:
            own = own.where(edges if not hasattr(edges, "__dataclass_fields__") else wide(edges))
        hop = own.select(F.col(f"{near}_type").alias("type"), F.col(f"{near}_id").alias("id"), F.col(f"{far}_type").alias("to_type"), F.col(f"{far}_id").alias("to_id"))
        reached = self._at.select("type", "id", "path").join(hop, ["type", "id"]).select(F.col("to_type").alias("type"), F.col("to_id").alias("id"), "path")
        found = self.vertices.join(reached, ["type", "id"])
        return self._with(found.withColumn("path", F.concat("path", F.array(F.struct("type", "id")))))

    def out(self, *labels: str, edges=None) -> Traversal:
        """Along edges with one of the labels (any, if none is given) that a condition on edges holds for."""
        return self._step("OUT", labels, edges)

    def in_(self, *labels: str, edges=None) -> Traversal:
        return self._step("IN", labels, edges)

    def has(self, where) -> Traversal:
        """Keep vertices that a condition holds for."""
        return self._with(self._at.where(where if not hasattr(where, "__dataclass_fields__") else wide(where)))

    def loop(self, times: int, direction: str = "OUT", *labels: str) -> Traversal:
        """The same step several times."""
        at = self
        for _ in range(times):
            at = at._step(direction, labels)
        return at

    def loop_while(self, goes_on, direction: str = "OUT", *labels: str, most: int = 10, edges=None) -> Traversal:
        """The same step again for those vertices that ``goes_on(loops)`` holds for, a condition on a vertex and the number of steps it took.

        Vertices that it doesn't hold for are the result. The condition is asked after each step, and after ``most`` steps
        all that are left are results too.
        """
        at, done = self, None
        for loops in range(1, most + 1):
            at = at._step(direction, labels, edges)
            rows = at._at
            condition = F.coalesce(goes_on(F.lit(loops)), F.lit(False)) if loops < most else F.lit(False)
            ended = rows.where(~condition)
            done = ended if done is None else done.unionByName(ended)
            at = at._with(rows.where(condition))
        return self._with(done)

    def frame(self) -> DataFrame:
        """The vertices reached, with their paths."""
        return self._at
