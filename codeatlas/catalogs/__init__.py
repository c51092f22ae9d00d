"""More queries of the register, by what they are about."""

from . import builds, files, language, relations, texts  # noqa: F401
