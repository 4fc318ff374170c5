"""What operators raise."""


class MeshError(Exception):
    """Base of all errors of this package."""


class InvalidRangeExpression(MeshError):
    pass


class InvalidTimespec(MeshError):
    pass


class IncorrectNumberOfArguments(MeshError):
    pass


class NodeExists(MeshError):
    pass


class CreateNode(MeshError):
    pass


class InvalidEnvironment(MeshError):
    pass


class NodeNotFound(MeshError):
    pass


class EdgeNotFound(MeshError):
    pass


class KeyNotFound(MeshError):
    pass


class IncorrectNodeType(MeshError):
    pass


class GraphCycle(MeshError):
    pass


class CorruptLog(MeshError):
    pass
