"""Errors of the library."""


class UndefinedEntityError(KeyError):
    """A name that no entity has."""


class AlreadyDefinedEntityError(ValueError):
    """A name that an entity has already."""


class UnsetEntityError(ValueError):
    """A value was asked for that an unset entity leaves missing."""


class IncompatibleEntityError(ValueError):
    """Entities or cases that don't fit together."""


class UnsupportedSerializedValueError(Exception):
    """A stored value that no codec reads."""


class CodeVersioningError(Exception):
    """A function's code changed but its version did not."""

    def __init__(self, message: str, bad_descriptor: str):
        super().__init__(message)
        self.bad_descriptor = bad_descriptor


class EntitySerializationError(Exception):
    """A codec failed to write a value."""


class EntityComputationError(Exception):
    """A function raised an error."""


class EntityValueError(ValueError):
    """A value that its codec or its descriptor does not allow."""


class AttributeValidationError(Exception):
    """A decorator was given twice or with what another forbids."""


class MalformedDescriptorError(Exception):
    """A descriptor that can't be read."""


class InvalidCacheStateError(Exception):
    """The store holds what it should not."""


class CacheEntryDeletionError(Exception):
    """An entry of the store can't be deleted."""
