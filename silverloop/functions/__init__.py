"""Column functions: labels, ids, vectors, prompts, replies."""
