"""What the rules find in the sample: rows (scan_id, file, severity, category, line, code), for each query over files."""

#: Fixed values. For the structure of YAML files, which has no line, the last field is the description.
EXPECTED = {
    "py_calls": (
        ("s1", "custom_components/x/__init__.py", "critical", "code_injection", 7, "eval(d)"),
        ("s1", "custom_components/x/calls.py", "critical", "code_injection", 9, "exec(a)"),
        ("s1", "custom_components/x/calls.py", "high", "code_injection", 10, "__import__(a)"),
        ("s1", "custom_components/x/calls.py", "medium", "code_injection", 8, "compile(a, b, c)"),
        ("s1", "custom_components/x/flows.py", "critical", "code_injection", 3, "eval(a)"),
        ("s1", "custom_components/x/flows.py", "critical", "code_injection", 12, "eval(a)"),
        ("s1", "custom_components/x/flows.py", "critical", "code_injection", 14, "exec(c)"),
    ),
    "py_imports": (
        ("s1", "custom_components/x/__init__.py", "critical", "command_execution", 4, "from os import system"),
        ("s1", "custom_components/x/__init__.py", "high", "command_execution", 2, "import subprocess"),
        ("s1", "custom_components/x/__init__.py", "info", "network", 3, "import requests"),
        ("s1", "custom_components/x/calls.py", "critical", "command_execution", 6, "from os import popen, system"),
        ("s1", "custom_components/x/calls.py", "high", "command_execution", 5, "import subprocess"),
        ("s1", "custom_components/x/calls.py", "high", "command_execution", 6, "from os import popen, system"),
        ("s1", "custom_components/x/calls.py", "high", "deserialization", 3, "import pickle, shelve"),
        ("s1", "custom_components/x/calls.py", "high", "native_code", 1, "import ctypes"),
        ("s1", "custom_components/x/calls.py", "info", "network", 7, "import aiohttp, ftplib, httpx, requests, smtplib, socket, telnetlib, urllib.request, urllib3"),
        ("s1", "custom_components/x/calls.py", "info", "network", 7, "import aiohttp, ftplib, httpx, requests, smtplib, socket, telnetlib, urllib.request, urllib3"),
        ("s1", "custom_components/x/calls.py", "info", "network", 7, "import aiohttp, ftplib, httpx, requests, smtplib, socket, telnetlib, urllib.request, urllib3"),
        ("s1", "custom_components/x/calls.py", "info", "network", 7, "import aiohttp, ftplib, httpx, requests, smtplib, socket, telnetlib, urllib.request, urllib3"),
        ("s1", "custom_components/x/calls.py", "info", "network", 7, "import aiohttp, ftplib, httpx, requests, smtplib, socket, telnetlib, urllib.request, urllib3"),
        ("s1", "custom_components/x/calls.py", "info", "network", 7, "import aiohttp, ftplib, httpx, requests, smtplib, socket, telnetlib, urllib.request, urllib3"),
        ("s1", "custom_components/x/calls.py", "info", "network", 7, "import aiohttp, ftplib, httpx, requests, smtplib, socket, telnetlib, urllib.request, urllib3"),
        ("s1", "custom_components/x/calls.py", "info", "network", 7, "import aiohttp, ftplib, httpx, requests, smtplib, socket, telnetlib, urllib.request, urllib3"),
        ("s1", "custom_components/x/calls.py", "info", "network", 7, "import aiohttp, ftplib, httpx, requests, smtplib, socket, telnetlib, urllib.request, urllib3"),
        ("s1", "custom_components/x/calls.py", "medium", "data_exfiltration", 4, "import webbrowser"),
        ("s1", "custom_components/x/calls.py", "medium", "deserialization", 2, "import marshal"),
        ("s1", "custom_components/x/calls.py", "medium", "deserialization", 3, "import pickle, shelve"),
    ),
    "py_taint": (
        ("s1", "custom_components/x/__init__.py", "critical", "taint_code_injection", 7, "eval(d)"),
        ("s1", "custom_components/x/__init__.py", "critical", "taint_command_injection", 6, "subprocess.run(d, shell=True)"),
        ("s1", "custom_components/x/flows.py", "critical", "taint_code_injection", 3, "eval(a)"),
        ("s1", "custom_components/x/flows.py", "critical", "taint_code_injection", 14, "exec(c)"),
        ("s1", "custom_components/x/flows.py", "critical", "taint_command_injection", 5, "os.system(b)"),
        ("s1", "custom_components/x/flows.py", "critical", "taint_command_injection", 7, "subprocess.run(b, shell=True)"),
        ("s1", "custom_components/x/flows.py", "high", "taint_command_injection", 6, "subprocess.run(b)"),
        ("s1", "custom_components/x/flows.py", "high", "taint_deserialization", 8, "pickle.loads(a)"),
        ("s1", "custom_components/x/flows.py", "high", "taint_path_traversal", 10, "open(a)"),
        ("s1", "custom_components/x/flows.py", "medium", "taint_deserialization", 9, "yaml.load(a)"),
    ),
    "api_rules": (
        ("s1", "custom_components/x/__init__.py", "high", "ha_auth_access", 9, "x = hass.auth"),
        ("s1", "custom_components/x/__init__.py", "high", "ha_dynamic_service", 8, "hass.services.call(a, b)"),
        ("s1", "custom_components/x/__init__.py", "medium", "ha_api_risk", 8, "hass.services.call(a, b)"),
        ("s1", "custom_components/x/__init__.py", "medium", "ha_no_validation", 10, "PLATFORM_SCHEMA = 1"),
        ("s1", "custom_components/x/platform.py", "high", "ha_auth_access", 8, "x = self._hass.auth"),
        ("s1", "custom_components/x/platform.py", "high", "ha_dynamic_service", 3, "self.hass.services.async_call(domain, 'x')"),
        ("s1", "custom_components/x/platform.py", "low", "ha_config_access", 9, "y = hass.config"),
        ("s1", "custom_components/x/platform.py", "medium", "ha_api_risk", 2, "hass.services.call('light', 'turn_on')"),
        ("s1", "custom_components/x/platform.py", "medium", "ha_api_risk", 3, "self.hass.services.async_call(domain, 'x')"),
        ("s1", "custom_components/x/platform.py", "medium", "ha_dynamic_entity", 6, "hass.states.set(entity, 1)"),
        ("s1", "custom_components/x/platform.py", "medium", "ha_event_injection", 4, "hass.bus.fire('e')"),
        ("s1", "custom_components/x/platform.py", "medium", "ha_event_injection", 5, "hass.bus.async_fire(name)"),
        ("s1", "custom_components/x/platform.py", "medium", "ha_no_validation", 10, "PLATFORM_SCHEMA = {}"),
    ),
    "js_rules": (
        ("s2", "broken.js", "info", "parse_info", None, ""),
        ("s2", "newer.mjs", "info", "parse_info", None, ""),
        ("s2", "card.js", "critical", "code_injection", 5, "eval(x);"),
        ("s2", "card.js", "critical", "code_injection", 18, "html = `<b>${eval(y)}</b> eval(0)`;"),
        ("s2", "card.js", "high", "code_injection", 6, "setTimeout('go()', 1);"),
        ("s2", "card.js", "high", "data_exfiltration", 10, "navigator.sendBeacon(u, d);"),
        ("s2", "card.js", "high", "script_injection", 11, "document.createElement('script');"),
        ("s2", "card.js", "high", "telemetry", 15, "gtag('event');"),
        ("s2", "card.js", "high", "xss", 3, "document.write('a'); document.cookie;"),
        ("s2", "card.js", "info", "network", 8, "fetch(u);"),
        ("s2", "card.js", "low", "data_access", 14, "localStorage.a = 1; sessionStorage.b = 2;"),
        ("s2", "card.js", "medium", "data_access", 3, "document.write('a'); document.cookie;"),
        ("s2", "card.js", "medium", "data_exfiltration", 9, "new WebSocket(u); new Image();"),
        ("s2", "card.js", "medium", "network", 9, "new WebSocket(u); new Image();"),
        ("s2", "card.js", "low", "telemetry", 21, "this.sentry.go();"),
        ("s2", "card.js", "medium", "obfuscation", 13, "atob(x); String.fromCharCode(1);"),
        ("s2", "card.js", "medium", "obfuscation", 19, "/'/.test(b); unescape(q); /'/.test(c);"),
        ("s2", "card.js", "medium", "obfuscation", 20, "x.map(atob);"),
        ("s2", "card.js", "medium", "script_injection", 12, "img.src = 'https://example.org/x.png';"),
        ("s2", "card.js", "medium", "telemetry", 16, "mixpanel(x);"),
        ("s2", "card.js", "medium", "xss", 1, "el.innerHTML = x; // eval(0)"),
        ("s2", "card.js", "medium", "xss", 2, "el.outerHTML += x;"),
        ("s2", "card.js", "medium", "xss", 4, "el.insertAdjacentHTML('beforeend', x);"),
    ),
    "yaml_structural": (
        ("s3", "automations.yaml", "high", "automation_injection", None, "service by template: {{ y }}"),
        ("s3", "automations.yaml", "high", "automation_injection", None, "service_template"),
        ("s3", "conf.yaml", "high", "automation_injection", None, "service by template: {{ x }}"),
        ("s3", "conf.yaml", "high", "automation_injection", None, "service_template"),
        ("s3", "conf.yaml", "high", "template_injection", None, "template in arg goes to script.go"),
        ("s3", "conf.yaml", "high", "template_injection", None, "template in arg goes to shell_command.go"),
        ("s3", "conf.yaml", "medium", "insecure_transport", None, "rest resource over http: http://example.com/a"),
        ("s3", "conf.yaml", "medium", "insecure_transport", None, "rest_command far over http"),
        ("s3", "conf.yaml", "medium", "insecure_transport", None, "rest_command plain over http"),
    ),
    "yaml_patterns": (
        ("s3", "bad.yaml", "medium", "command_execution", 2, "shell_command:"),
        ("s3", "conf.yaml", "critical", "code_injection", 25, "run: \"{{ eval(x) }}\""),
        ("s3", "conf.yaml", "high", "hardcoded_secret", 23, "password: abcdefgh123"),
        ("s3", "conf.yaml", "high", "template_injection", 19, "go: \"echo {{ states('x') }}\""),
        ("s3", "conf.yaml", "low", "insecure_transport", 22, "url: http://example.org/a"),
        ("s3", "conf.yaml", "medium", "command_execution", 18, "shell_command:"),
        ("s3", "conf.yaml", "medium", "command_execution", 20, "command_line:"),
    ),
    "yaml_includes": (
        ("s3", "includes.yaml", "high", "unsafe_include", 1, "inc: !include {{ x }}.yaml"),
        ("s3", "includes.yaml", "medium", "unsafe_include", 2, "abs: !include /etc/x.yaml"),
        ("s3", "includes.yaml", "medium", "unsafe_include", 3, "up: !include ../x.yaml"),
    ),
    "full_scan": (
        ("s1", "custom_components/x/__init__.py", "critical", "code_injection", 7, "eval(d)"),
        ("s1", "custom_components/x/__init__.py", "critical", "command_execution", 4, "from os import system"),
        ("s1", "custom_components/x/__init__.py", "critical", "taint_command_injection", 6, "subprocess.run(d, shell=True)"),
        ("s1", "custom_components/x/__init__.py", "high", "command_execution", 2, "import subprocess"),
        ("s1", "custom_components/x/__init__.py", "high", "ha_auth_access", 9, "x = hass.auth"),
        ("s1", "custom_components/x/__init__.py", "high", "ha_dynamic_service", 8, "hass.services.call(a, b)"),
        ("s1", "custom_components/x/__init__.py", "info", "network", 3, "import requests"),
        ("s1", "custom_components/x/__init__.py", "medium", "ha_no_validation", 10, "PLATFORM_SCHEMA = 1"),
        ("s1", "custom_components/x/broken.py", "medium", "obfuscation", 3, "base64.b64decode(x)"),
        ("s1", "custom_components/x/calls.py", "critical", "code_injection", 9, "exec(a)"),
        ("s1", "custom_components/x/calls.py", "critical", "command_execution", 6, "from os import popen, system"),
        ("s1", "custom_components/x/calls.py", "high", "code_injection", 10, "__import__(a)"),
        ("s1", "custom_components/x/calls.py", "high", "command_execution", 5, "import subprocess"),
        ("s1", "custom_components/x/calls.py", "high", "deserialization", 3, "import pickle, shelve"),
        ("s1", "custom_components/x/calls.py", "high", "native_code", 1, "import ctypes"),
        ("s1", "custom_components/x/calls.py", "info", "network", 7, "import aiohttp, ftplib, httpx, requests, smtplib, socket, telnetlib, urllib.request, urllib3"),
        ("s1", "custom_components/x/calls.py", "medium", "code_injection", 8, "compile(a, b, c)"),
        ("s1", "custom_components/x/calls.py", "medium", "data_exfiltration", 4, "import webbrowser"),
        ("s1", "custom_components/x/calls.py", "medium", "deserialization", 2, "import marshal"),
        ("s1", "custom_components/x/flows.py", "critical", "code_injection", 3, "eval(a)"),
        ("s1", "custom_components/x/flows.py", "critical", "code_injection", 12, "eval(a)"),
        ("s1", "custom_components/x/flows.py", "critical", "code_injection", 14, "exec(c)"),
        ("s1", "custom_components/x/flows.py", "critical", "taint_command_injection", 5, "os.system(b)"),
        ("s1", "custom_components/x/flows.py", "critical", "taint_command_injection", 7, "subprocess.run(b, shell=True)"),
        ("s1", "custom_components/x/flows.py", "high", "taint_command_injection", 6, "subprocess.run(b)"),
        ("s1", "custom_components/x/flows.py", "high", "taint_deserialization", 8, "pickle.loads(a)"),
        ("s1", "custom_components/x/flows.py", "high", "taint_path_traversal", 10, "open(a)"),
        ("s1", "custom_components/x/flows.py", "medium", "taint_deserialization", 9, "yaml.load(a)"),
        ("s1", "custom_components/x/platform.py", "high", "ha_auth_access", 8, "x = self._hass.auth"),
        ("s1", "custom_components/x/platform.py", "high", "ha_dynamic_service", 3, "self.hass.services.async_call(domain, 'x')"),
        ("s1", "custom_components/x/platform.py", "low", "ha_config_access", 9, "y = hass.config"),
        ("s1", "custom_components/x/platform.py", "medium", "ha_api_risk", 2, "hass.services.call('light', 'turn_on')"),
        ("s1", "custom_components/x/platform.py", "medium", "ha_dynamic_entity", 6, "hass.states.set(entity, 1)"),
        ("s1", "custom_components/x/platform.py", "medium", "ha_event_injection", 4, "hass.bus.fire('e')"),
        ("s1", "custom_components/x/platform.py", "medium", "ha_event_injection", 5, "hass.bus.async_fire(name)"),
        ("s1", "custom_components/x/platform.py", "medium", "ha_no_validation", 10, "PLATFORM_SCHEMA = {}"),
        ("s1", "manifest.json", "critical", "malicious_package", None, ""),
        ("s2", "(repo)", "info", "parse_info", None, ""),
        ("s2", "broken.js", "critical", "code_injection", 1, "function ( { eval(x)"),
        ("s2", "card.js", "critical", "code_injection", 5, "eval(x);"),
        ("s2", "card.js", "critical", "code_injection", 18, "html = `<b>${eval(y)}</b> eval(0)`;"),
        ("s2", "card.js", "high", "code_injection", 6, "setTimeout('go()', 1);"),
        ("s2", "card.js", "high", "data_exfiltration", 10, "navigator.sendBeacon(u, d);"),
        ("s2", "card.js", "high", "script_injection", 11, "document.createElement('script');"),
        ("s2", "card.js", "high", "telemetry", 15, "gtag('event');"),
        ("s2", "card.js", "high", "xss", 3, "document.write('a'); document.cookie;"),
        ("s2", "card.js", "info", "network", 8, "fetch(u);"),
        ("s2", "card.js", "low", "data_access", 14, "localStorage.a = 1; sessionStorage.b = 2;"),
        ("s2", "card.js", "medium", "data_access", 3, "document.write('a'); document.cookie;"),
        ("s2", "card.js", "medium", "data_exfiltration", 9, "new WebSocket(u); new Image();"),
        ("s2", "card.js", "medium", "network", 9, "new WebSocket(u); new Image();"),
        ("s2", "card.js", "low", "telemetry", 21, "this.sentry.go();"),
        ("s2", "card.js", "medium", "obfuscation", 13, "atob(x); String.fromCharCode(1);"),
        ("s2", "card.js", "medium", "obfuscation", 19, "/'/.test(b); unescape(q); /'/.test(c);"),
        ("s2", "card.js", "medium", "obfuscation", 20, "x.map(atob);"),
        ("s2", "card.js", "medium", "script_injection", 12, "img.src = 'https://example.org/x.png';"),
        ("s2", "card.js", "medium", "telemetry", 16, "mixpanel(x);"),
        ("s2", "card.js", "medium", "xss", 1, "el.innerHTML = x; // eval(0)"),
        ("s2", "card.js", "medium", "xss", 2, "el.outerHTML += x;"),
        ("s2", "newer.mjs", "medium", "data_access", 1, "a?.b(`${document.cookie}`);"),
        ("s2", "package.json", "critical", "malicious_package", None, ""),
        ("s3", "automations.yaml", "high", "automation_injection", None, ""),
        ("s3", "bad.yaml", "medium", "command_execution", 2, "shell_command:"),
        ("s3", "conf.yaml", "critical", "code_injection", 25, "run: \"{{ eval(x) }}\""),
        ("s3", "conf.yaml", "high", "automation_injection", None, ""),
        ("s3", "conf.yaml", "high", "hardcoded_secret", 23, "password: abcdefgh123"),
        ("s3", "conf.yaml", "high", "template_injection", 19, "go: \"echo {{ states('x') }}\""),
        ("s3", "conf.yaml", "high", "template_injection", None, ""),
        ("s3", "conf.yaml", "low", "insecure_transport", 22, "url: http://example.org/a"),
        ("s3", "conf.yaml", "medium", "command_execution", 18, "shell_command:"),
        ("s3", "conf.yaml", "medium", "command_execution", 20, "command_line:"),
        ("s3", "conf.yaml", "medium", "hardcoded_secret", 26, "# token: abcdefgh12345"),
        ("s3", "conf.yaml", "medium", "insecure_transport", None, ""),
        ("s3", "includes.yaml", "high", "unsafe_include", 1, "inc: !include {{ x }}.yaml"),
        ("s3", "includes.yaml", "medium", "unsafe_include", 2, "abs: !include /etc/x.yaml"),
        ("s3", "includes.yaml", "medium", "unsafe_include", 3, "up: !include ../x.yaml"),
        ("s3", "requirements.txt", "critical", "malicious_package", None, ""),
    ),
}
