"""A small component of every kind of file, in which every rule is hit, as rows (scan_id, path, content)."""

PYTHON = """import ctypes
import marshal
import pickle, shelve
import webbrowser
import subprocess
from os import popen, system
import aiohttp, ftplib, httpx, requests, smtplib, socket, telnetlib, urllib.request, urllib3
compile(a, b, c)
exec(a)
__import__(a)
re.compile(a)
"""
FLOWS = """def f(request, hass):
    a = request.query
    eval(a)
    b = a + 'x'
    os.system(b)
    subprocess.run(b)
    subprocess.run(b, shell=True)
    pickle.loads(a)
    yaml.load(a)
    open(a)
    a = 'fixed'
    eval(a)
c = input()
exec(c)
"""
PLATFORM = """import voluptuous as vol
hass.services.call('light', 'turn_on')
self.hass.services.async_call(domain, 'x')
hass.bus.fire('e')
hass.bus.async_fire(name)
hass.states.set(entity, 1)
hass.states.async_set('a.b', 1)
x = self._hass.auth
y = hass.config
PLATFORM_SCHEMA = {}
CONFIG_SCHEMA = vol.Schema({})(vol.Optional('x'))
z = other.auth
"""
SCRIPT = """el.innerHTML = x; // eval(0)
el.outerHTML += x;
document.write('a'); document.cookie;
el.insertAdjacentHTML('beforeend', x);
eval(x);
setTimeout('go()', 1);
setInterval(go, 1);
fetch(u);
new WebSocket(u); new Image();
navigator.sendBeacon(u, d);
document.createElement('script');
img.src = 'https://example.org/x.png';
atob(x); String.fromCharCode(1);
localStorage.a = 1; sessionStorage.b = 2;
gtag('event');
mixpanel(x);
'eval(1)';
html = `<b>${eval(y)}</b> eval(0)`;
/'/.test(b); unescape(q); /'/.test(c);
x.map(atob);
this.sentry.go();
q = a / eval / b; // no call
"""
YAML = """automation:
  - action:
      - service: "{{ x }}"
      - service_template: light.on
      - service: shell_command.go
        data: {arg: "{{ y }}", ok: plain}
      - choose:
          - sequence:
              - service: script.go
                data_template: {arg: "{% if a %}"}
rest_command:
  far: {url: "http://example.org/x"}
  near: {url: "http://192.168.1.2/x"}
  plain: http://example.net/
rest:
  - resource: http://10.0.0.1/x
  - resource: http://example.com/a
shell_command:
  go: "echo {{ states('x') }}"
command_line:
url: http://172.16.0.1/a
url: http://example.org/a
password: abcdefgh123
api_key: !secret k
run: "{{ eval(x) }}"
# token: abcdefgh12345
"""
AUTOMATIONS = """- alias: a
  action:
    service: "{{ y }}"
- sequence:
    - choose:
        - sequence:
            - service_template: z
- nothing
"""
INCLUDES = """inc: !include {{ x }}.yaml
abs: !include /etc/x.yaml
up: !include ../x.yaml
fine: !include ok.yaml
"""

SAMPLE = (
    ("s1", "custom_components/x/manifest.json", '{"domain": "x", "name": "X", "requirements": ["ctx==1.0", "requests>=2.1"]}'),
    ("s1", "custom_components/x/__init__.py", "import os\nimport subprocess\nimport requests\nfrom os import system\nd = entry.data['u']\nsubprocess.run(d, shell=True)\neval(d)\nhass.services.call(a, b)\nx = hass.auth\nPLATFORM_SCHEMA = 1\nu = 'https://api.example.com/v1'\n"),
    ("s1", "custom_components/x/broken.py", "import pickle\ndef broken(:\n    base64.b64decode(x)\n"),
    ("s1", "custom_components/x/calls.py", PYTHON),
    ("s1", "custom_components/x/flows.py", FLOWS),
    ("s1", "custom_components/x/platform.py", PLATFORM),
    ("s1", "tests/test_x.py", "eval(1)\n"),
    ("s2", "card.js", SCRIPT),
    ("s2", "broken.js", "function ( { eval(x)\n"),
    ("s2", "newer.mjs", "a?.b(`${document.cookie}`);\n"),
    ("s2", "my-prism.min.js", "eval(x)\n"),
    ("s2", "package.json", '{"dependencies": {"event-stream": "^3.3.6"}, "devDependencies": {"left-pad": "~1.3.0"}}'),
    ("s3", "conf.yaml", YAML),
    ("s3", "includes.yaml", INCLUDES),
    ("s3", "list.yaml", "- service: '{{ x }}'\n"),
    ("s3", "automations.yaml", AUTOMATIONS),
    ("s3", "bad.yaml", "a: [\nshell_command:\n"),
    ("s3", "requirements.txt", "# none\nflask==2.0\n-r other.txt\nurlib3>=1.0\n"),
    ("s3", "pyproject.toml", "[project]\nname = 'x'\ndependencies = [\n  \"numpy>=1.20\",\n]\n"),
)
