"""Tessera: a codebase-knowledge and text analytics engine made of DataFrame-to-DataFrame operators."""
