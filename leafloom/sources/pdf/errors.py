"""The one error that malformed files raise."""


class PdfError(ValueError):
    """A file, or a part of it, is malformed."""
