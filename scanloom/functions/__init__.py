"""Column functions: identifiers, text, coercion, geometry and scores."""
