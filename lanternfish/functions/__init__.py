"""Subpackage; see the package README."""
