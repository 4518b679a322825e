"""What goes wrong, by kind."""


class LakeError(Exception):
    """Base of the errors below."""


class CatalogError(LakeError):
    """An object is missing, exists already, or is still needed."""


class InvalidInput(LakeError):
    """An argument or a file doesn't fit."""


class InvalidConfiguration(LakeError):
    """The lake's settings forbid it."""


class ConstraintError(LakeError):
    """A row breaks NOT NULL."""


class NotSupported(LakeError, NotImplementedError):
    """The format has no such thing."""


class ConflictError(LakeError):
    """Another commit changed what this one relies on."""
