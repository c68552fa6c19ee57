"""Error taxonomy: a code ``SUBSYSTEM-Xnnn``, severity and retryability."""

from __future__ import annotations

from enum import Enum


class Severity(Enum):
    FATAL = "F"
    ERROR = "E"
    WARNING = "W"

    @property
    def code(self) -> str:
        return self.value

    def as_str(self) -> str:
        return self.name.lower()


class GraphError(Exception):
    """Base of all errors; subclasses fix the code and the message's shape."""

    code = "SYS-E002"
    template = "Something went wrong inside: {message}"
    retryable = False

    def __init__(self, **context: object):
        self.context = context
        super().__init__(f"{self.code}: {self.template.format(**context)}")

    @property
    def subsystem(self) -> str:
        return self.code.split("-")[0]

    @property
    def severity(self) -> Severity:
        return Severity(self.code.split("-")[1][0])

    @property
    def is_fatal(self) -> bool:
        return self.severity is Severity.FATAL


def _error(name: str, code: str, template: str, retryable: bool = False) -> type[GraphError]:
    return type(name, (GraphError,), {"code": code, "template": template, "retryable": retryable, "__module__": __name__})


Internal = _error("Internal", "SYS-E002", "Something went wrong inside: {message}")
CircuitOpen = _error("CircuitOpen", "SYS-E001", "Calls are refused for now: too many have failed", retryable=True)
OutOfMemory = _error("OutOfMemory", "CSR-E001", "{requested} bytes were asked for and {available} are free", retryable=True)
InvalidEdge = _error("InvalidEdge", "CSR-E002", "Edge {source} -> {target} has an end that is no node id")
UnsupportedGraphSize = _error("UnsupportedGraphSize", "CSR-E003", "A graph of this size cannot be built: {reason}")
ShardCorruption = _error("ShardCorruption", "CSR-F001", "Stored adjacency {path} is damaged ({reason})")
DeltaOverflow = _error("DeltaOverflow", "DLT-E001", "{count} pending changes are more than the {threshold} that are allowed")
CompactionFailed = _error("CompactionFailed", "DLT-E002", "Pending changes could not be merged: {reason}")
NodeNotFound = _error("NodeNotFound", "TRV-E001", "There is no node {node}")
InvalidTraversal = _error("InvalidTraversal", "TRV-E002", "This traversal makes no sense: {reason}")
TraversalTimeout = _error("TraversalTimeout", "TRV-E003", "Stopped after {seconds} s, at depth {depth}", retryable=True)
CycleLimitExceeded = _error("CycleLimitExceeded", "TRV-E004", "Too many cycles through node {node}")
MemoryLimitExceeded = _error("MemoryLimitExceeded", "MEM-E001", "{requested} bytes are needed, the limit is {limit}", retryable=True)
OntologyParse = _error("OntologyParse", "ONT-E001", "Not valid {kind}: {reason}")
MissingField = _error("MissingField", "ONT-E002", "'{field}' has to be given in {where}")
DanglingEdge = _error("DanglingEdge", "ONT-E003", "Edge '{edge}' names a node '{node}' that is not defined")
DuplicateLabel = _error("DuplicateLabel", "ONT-E004", "Two definitions of {kind} '{label}'")
TypeMismatch = _error("TypeMismatch", "ONT-E005", "'{field}' should be {expected} and is {actual}")
OntologyIo = _error("OntologyIo", "ONT-E006", "The ontology file could not be read: {reason}")
ComputedPropertyTarget = _error("ComputedPropertyTarget", "ONT-E007", "Computed property '{name}' needs a node or an edge, and not both")
PlanError = _error("PlanError", "DFN-E001", "No plan: {reason}")
ExecutionError = _error("ExecutionError", "DFN-E002", "A step failed while it ran: {reason}")
NotImplementedYet = _error("NotImplementedYet", "DFN-E003", "This engine does not do that yet: {feature}")
ArrowInterchange = _error("ArrowInterchange", "FFI-E001", "Arrow data could not be passed on: {reason}")
NullPointer = _error("NullPointer", "FFI-E002", "{argument} is null")
InvalidArrowSchema = _error("InvalidArrowSchema", "FFI-E003", "Unusable Arrow schema: {reason}")
