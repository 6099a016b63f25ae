"""Column functions: text, scoring and prompts."""
