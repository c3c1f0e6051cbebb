"""What is read off factor panels: evidence, quality, portfolios, performance."""
