"""Errors of the library."""


class GraphError(Exception):
    pass


class ParseError(GraphError):
    def __init__(self, position: int, message: str):
        super().__init__(f"at {position}: {message}")
        self.position, self.message = position, message


class AnalysisError(GraphError):
    """A query that parses but means nothing, such as an unknown function or variable."""


class NodeNotFound(GraphError):
    pass


class EdgeNotFound(GraphError):
    pass


class DuplicateNode(GraphError):
    pass


class DimensionMismatch(GraphError):
    pass


class NoEmbedding(GraphError):
    pass
