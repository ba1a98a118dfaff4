"""Part of the lodestone corpus engine."""
