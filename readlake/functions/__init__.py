"""See the package README section."""
