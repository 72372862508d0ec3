"""What happened next: books of (state, move, count) over very large collections of sequences."""
