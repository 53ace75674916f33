"""Part of pactum; see README.md."""
