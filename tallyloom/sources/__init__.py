"""Reading, describing, creating, generating and writing tables."""
