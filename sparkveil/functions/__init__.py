"""Column functions: text, regular expressions with offsets, entropy, globs, base64."""
