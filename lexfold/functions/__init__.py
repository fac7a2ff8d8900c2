"""Column functions: text, labels, prompts, vectors."""
