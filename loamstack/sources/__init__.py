"""Scans of workspaces, import trees and request logs."""
