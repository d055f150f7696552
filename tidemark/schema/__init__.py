"""Schemas as code, compatibility, registry, evolution and projection."""
