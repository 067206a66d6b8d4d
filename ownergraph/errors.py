"""Every way in which a step refuses to go on, as a type of its own."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all refusals."""


class InvalidConfiguration(EngineError): ...


class IncompletePeriod(EngineError): ...


class TransientFailure(EngineError): ...


class UnsafeArchive(EngineError): ...


class InsufficientSpace(EngineError): ...


class ChecksumMismatch(EngineError): ...


class CountMismatch(EngineError): ...


class DuplicateCode(EngineError): ...


class BlankDescription(EngineError): ...


class MissingInput(EngineError): ...


class EmptySlice(EngineError): ...


class MalformedCapital(EngineError): ...


class MissingCompany(EngineError): ...


class LostLink(EngineError): ...


class DuplicateCompany(EngineError): ...


class QualityError(EngineError):
    """Some quality rules are broken; the message lists every finding."""


class IndexNotDense(EngineError): ...


class UnorderedExistence(EngineError): ...


class UnknownEndpoint(EngineError): ...


class LostEdge(EngineError): ...


class IndexOutOfRange(EngineError): ...


class RoleNotNumeric(EngineError): ...


class RoleOutOfRange(EngineError): ...


class UnorderedNeighbours(EngineError): ...


class BrokenSymmetry(EngineError): ...


class LabelNotCanonical(EngineError): ...


class RateMismatch(EngineError): ...


class NameMismatch(EngineError): ...


class IncompatibleArtefacts(EngineError): ...


class InconsistentArtefacts(EngineError): ...


class InvalidRequest(EngineError): ...


class ReleaseMismatch(EngineError): ...
