"""marlgate.llm: operators on free text. Nothing else in the library imports this subpackage."""
