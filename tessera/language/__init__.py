"""Plain-language requests and edits. Driver-side text work only."""
