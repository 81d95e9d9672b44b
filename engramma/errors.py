"""Failures, with the fields a caller can act on."""


class EngrammaError(Exception):
    """Base of all failures of this package."""


class EmptyAttributeValues(EngrammaError):
    def __init__(self):
        super().__init__("an attribute requires at least one value")


class EmptyEpisodeAttributes(EngrammaError):
    def __init__(self):
        super().__init__("an episode requires at least one attribute")


class ZeroMemoryId(EngrammaError):
    def __init__(self):
        super().__init__("a memory identifier must be non-zero")


class OutOfRange(EngrammaError):
    def __init__(self, value: int):
        self.value = value
        super().__init__(f"fixed-point value {value} exceeds 1000000")


class IdExhausted(EngrammaError):
    def __init__(self):
        super().__init__("atom identifier space is exhausted")


class UnknownAtom(EngrammaError):
    def __init__(self, atom: str):
        self.atom = atom
        super().__init__(f"unknown atom {atom}")


class FeedbackTargetLimitExceeded(EngrammaError):
    def __init__(self, count: int, most: int):
        self.count, self.max = count, most
        super().__init__(f"feedback target count {count} exceeds {most}")


class SelfEdge(EngrammaError):
    def __init__(self, atom: str):
        self.atom = atom
        super().__init__(f"atom {atom} cannot have feedback about itself")


class InvalidSymbolValue(EngrammaError):
    def __init__(self, index: int, detail: str):
        self.index, self.detail = index, detail
        super().__init__(f"invalid symbol at batch index {index}: {detail}")


class UnknownSymbolId(EngrammaError):
    def __init__(self, id: int):
        self.id = id
        super().__init__(f"unknown symbol identifier {id}")


class ConcurrentModification(EngrammaError):
    def __init__(self, expected: int, actual: int):
        self.expected_revision, self.actual_revision = expected, actual
        super().__init__(f"memory revision changed from {expected} to {actual}")


class RevisionExhausted(EngrammaError):
    def __init__(self):
        super().__init__("memory snapshot revision is exhausted")


class SymbolIdExhausted(EngrammaError):
    def __init__(self):
        super().__init__("symbol identifier space is exhausted")


class InvalidStore(EngrammaError):
    """Persisted data that breaks an invariant; nothing is repaired. The kinds below carry what a caller can act on."""

    def __init__(self, detail: str):
        self.detail = detail
        super().__init__(f"invalid memory store: {detail}")


class MissingMetadata(InvalidStore):
    def __init__(self):
        super().__init__("memory metadata row is missing")


class UnsupportedFormatVersion(InvalidStore):
    def __init__(self, found):
        self.found = found
        super().__init__(f"unsupported memory format version {found}")


class Unreadable(InvalidStore):
    """A segment that the manifest names cannot be read."""

    def __init__(self, detail: str):
        super().__init__(f"segment check failed: {detail}")


class InvalidEncoding(InvalidStore):
    def __init__(self, table: str, column: str):
        self.table, self.column = table, column
        super().__init__(f"invalid encoding in {table}.{column}")


class InvalidMemoryId(InvalidStore):
    def __init__(self):
        super().__init__("invalid persisted memory ID")


class InvalidMetadata(InvalidStore):
    def __init__(self, detail: str):
        super().__init__(f"invalid metadata: {detail}")
        self.detail = detail


class NonContiguousEpisodeSequence(InvalidStore):
    def __init__(self, expected: int, found: int):
        self.expected, self.found = expected, found
        super().__init__(f"expected episode sequence {expected}, found {found}")


class NonContiguousSymbolId(InvalidStore):
    def __init__(self, expected: int, found: int):
        self.expected, self.found = expected, found
        super().__init__(f"expected symbol identifier {expected}, found {found}")


class InvalidSymbol(InvalidStore):
    def __init__(self, id: int, detail: str):
        super().__init__(f"invalid symbol {id}: {detail}")
        self.id, self.detail = id, detail


class InvalidEpisode(InvalidStore):
    def __init__(self, sequence: int, detail: str):
        super().__init__(f"invalid episode {sequence}: {detail}")
        self.sequence, self.detail = sequence, detail


class InvalidFeedback(InvalidStore):
    def __init__(self, source: int, target: int, detail: str):
        super().__init__(f"invalid feedback edge {source}->{target}: {detail}")
        self.source, self.target, self.detail = source, target, detail


class EpisodeDecodeError(EngrammaError):
    def __init__(self, detail: str):
        self.detail = detail
        super().__init__(detail)
