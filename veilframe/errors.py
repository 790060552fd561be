"""Errors on the driver; on the executors failures are columns, never exceptions."""


class VeilError(Exception):
    """Any failure of this package."""


class ProfileError(VeilError):
    """A profile that is missing, no YAML or not valid."""


class ExtractionError(VeilError):
    """An input that cannot be opened or read."""


class NoTextLayerError(VeilError):
    """An input without text where recognition is switched off."""


class RedactionError(VeilError):
    """Redaction did not come to rest."""


class VerificationError(VeilError):
    """Personal data survived redaction."""


class VaultError(VeilError):
    """The profile store is broken, locked or lacks an entry."""


class SecurityError(VeilError):
    """A file that others may read."""
