"""Column functions: white space, words, sentences, tokens."""
