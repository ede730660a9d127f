"""Column functions: typed attribute parsing, text cleaning, links, and tag rules on text."""
